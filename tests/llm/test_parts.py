"""Parts of the operators on their own."""

import io
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyhold.llm import langid, lattice, repeats, suffixes, toxicity, warc
from tallyhold.llm.common import RowTable
from tallyhold.llm.tokens import PieceCache


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(s):
    assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab c.é", max_size=50).map(str.encode).filter(bool), min_size=1, max_size=5, unique=True), st.integers(2, 20))
def test_repeated_starts(contents, size):
    n = Counter(c[i : i + size] for c in contents for i in range(len(c) - size + 1))
    got = suffixes.repeated_starts(contents, size)
    assert [x.tolist() for x in got] == [[i for i in range(len(c) - size + 1) if n[c[i : i + size]] > 1] for c in contents]


def test_long_pieces_fall_back_to_bytes():
    a, b = b"x" * 100 + b" end", b"y" + b"x" * 99 + b" end"
    got = suffixes.repeated_starts([a, b], 50)
    assert got[0].tolist() == list(range(len(a) - 49)) and got[1].tolist() == list(range(1, len(b) - 49))


@settings(max_examples=150, deadline=None)
@given(st.text("ab c", min_size=30, max_size=200).map(str.encode))
def test_equal_windows_have_equal_anchors(text):
    size, gram = 20, 8
    key, first, last, count = repeats.anchors(text, size, gram)
    assert first[0] == 0 and last[-1] == len(text) - size and (first[1:] == last[:-1] + 1).all() and (count >= 1).all()
    by = {}
    for k, a, b, n in zip(key.tolist(), first.tolist(), last.tolist(), count.tolist(), strict=True):
        for s in range(a, b + 1):
            w = text[s : s + size]
            assert by.setdefault(w, k) == k
        inside = [text[s : s + size] for s in range(a, b + 1)]
        if len(set(inside)) < len(inside):
            assert n > 1


def test_spans_merge():
    blob = np.array([[5, 9], [0, 3], [3, 4], [8, 12], [20, 21]], "<u4").tobytes()
    assert repeats.merged([blob]).tolist() == [[0, 4], [5, 12], [20, 21]] and repeats.merged([]).tolist() == []
    one = repeats.merged([blob]).astype("<u4").tobytes()
    assert repeats.cut(b"0123456789abcdefghijklmn", one)[0] == b"4cdefghijlmn" and repeats.cut(b"abc", None)[0] == b"abc"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("  aaB1's\n\n\té日.!　\x1c\x01\r")), max_size=40), min_size=1, max_size=5))
def test_ids_are_the_library_s(texts):
    tok, cache = _TOK, _CACHE
    assert cache.encode([*texts, None]) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts] + [b""]


_TOK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
_CACHE = PieceCache(public_tokenizers.path("byte_bpe_50k.json"), room=10_000)


def test_ids_of_both_libraries_are_equal():
    texts = ["Hello, world! don't", "é日本 ñ  two", "tail ", "\n\n a"]
    assert PieceCache(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode(texts) == _CACHE.encode(texts)


def test_marginal_is_the_sum_over_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "<0xC3>", "<0xA9>"]
    p = np.array([0.1, 0.2, 0.1, 0.1, 0.15, 0.05, 0.1, 0.1, 0.05])
    own = lattice.Lattice(pieces, np.log(p), np.log(0.05))
    prob = dict(zip(pieces, p, strict=True))

    def total(s):
        return 1.0 if not s else sum(prob[x] * total(s[len(x) :]) for x in prob if s.startswith(x))

    for word in ("a", "ab", "abab", "aabba", "b" * 40):
        assert own.log_marginal(word) == pytest.approx(np.log(total("▁" + word)))
    assert own.log_marginal("é") == pytest.approx(np.log(0.1 * 0.1 * 0.05))
    assert np.isfinite(own.log_marginal("ab" * 50_000))
    for word in ("abab", "éa"):
        counts, long = [0.0] * len(pieces), [0.0] * len(pieces)
        own.expect(word, 2.0, counts)
        own._expect_long(own.edges(word), len(word) + 1, 2.0, long)
        assert counts == pytest.approx(long)
        spelt = sum(c * len(x) for c, x in zip(counts, pieces, strict=True) if not x.startswith("<"))
        assert spelt == pytest.approx(2.0 * (len(word) + 1 - word.count("é")))


def test_expected_counts_of_improbable_words():
    first = lattice.first_lattice()
    used = np.isfinite(first.logs)
    least = lattice.Lattice(first.pieces, np.where(used, first.logs - 12.0, first.logs), first.end)
    longer = {c for p in first.pieces if len(p) > 1 for c in p}
    rare = min(c for c in first.single - longer if ord(c) > 0x3000)
    for own in (first, least):
        for word in [d * k for d in ("7", rare) for k in range(40, 60)] + ["0123456789" * 5 + rare * 8]:
            counts, long = [0.0] * len(own.pieces), [0.0] * len(own.pieces)
            own.expect(word, 3.0, counts)
            own._expect_long(own.edges(word), len(word) + 1, 3.0, long)
            assert np.allclose(counts, long, rtol=1e-9, atol=1e-12)
            spelt = sum(c * len(x) for c, x in zip(counts, own.pieces, strict=True) if c)
            assert spelt == pytest.approx(3.0 * (len(word) + 1))


def test_training_raises_the_likelihood():
    start = lattice.first_lattice()
    words = {"the": 50, "thing": 10, "erthing": 5, "of": 30}
    score = [sum(n * m.log_marginal(w) for w, n in words.items()) for m in (start, _trained(start, words))]
    assert score[1] > score[0]


def _trained(m, words):
    sums = [0.0] * len(m.pieces)
    for w, n in words.items():
        m.expect(w, n, sums)
    with np.errstate(divide="ignore"):
        return lattice.Lattice(m.pieces, np.log(np.array(sums) / (sum(sums) + 10)), np.log(10 / (sum(sums) + 10)))


def test_misspelt_words_share_vectors():
    r = random.Random(1)
    clean = ["ta", "lo", "mi", "ren", "sol", "dar", "vin", "pel"]
    bad = ["stupid", "moronic", "garbage"]
    rows = [" ".join("".join(r.choices(clean, k=r.randint(1, 3))) for _ in range(60)) for _ in range(300)]
    marks = [k % 3 == 0 for k in range(300)]
    texts = [t if not m else " ".join(w if r.random() > 0.05 else r.choice(bad) for w in t.split()) + " " + r.choice(bad) for t, m in zip(rows, marks, strict=True)]
    model = toxicity.fit(texts, [int(m) for m in marks], 1 / 3, epochs=20)
    plain, wrong = model.scores(RowTable(model.word, 2), [rows[0], rows[0] + " stuupid morronic garbagge stupidd"])
    assert plain < 0.3 < wrong


def test_codes_are_apart():
    for n in (2, 3, 4, 5, 9):
        code = langid.codewords(n)
        apart = (code[:, None] != code[None]).sum(2)[~np.eye(n, dtype=bool)]
        assert apart.min() >= max(1, code.shape[1] // 3) and (code.sum(0) > 0).all() and (code.sum(0) < n).all()


def test_languages_are_told_apart_and_doubt_is_flagged():
    r = random.Random(2)
    sounds = {"a": ["th", "er", "ing", "on"], "b": ["sch", "ei", "ung", "ach"], "c": ["que", "eau", "oi", "ment"]}

    def text(k, n=20):
        return " ".join("".join(r.choices(sounds[k], k=2)) for _ in range(n))

    langs = [k for k in sounds for _ in range(80)]
    model = langid.fit([text(k) for k in langs], langs)
    table = RowTable(model.word, model.weight.shape[1] + 1)
    best, score, close = model.decode(model.margins(table, [text(k) for k in langs]))
    assert np.mean([model.langs[i] == k for i, k in zip(best, langs, strict=True)]) > 0.97 and (score <= 1).all()
    mixed = [text("a", 10) + " " + text("b", 10) for _ in range(50)]
    assert model.decode(model.margins(table, mixed))[1].mean() < score.mean()


def archive(records, content=b""):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content))
    return b"".join(packer.compress(r) for r in records)


def skippable(content):
    return warc.SKIPPABLE + len(content).to_bytes(4, "little") + content


@pytest.mark.parametrize("chunk", [3, 100, 1 << 20])
def test_frames(chunk):
    raw = [warc.record(i, "u", b"p" * i * 50, i * 50, warc.digest32(b"p" * i * 50), None, "2024-01-01T00:00:00Z") for i in range(5)]
    content = b"WARC/1.1 WARC-Type: response Content-Type: application/http" * 20
    assert list(warc.frames(io.BytesIO(skippable(content) + archive(raw, content)), chunk)) == raw
    packed = zstandard.compress(content)
    assert list(warc.frames(io.BytesIO(skippable(packed) + archive(raw, content)), chunk)) == raw
    assert list(warc.frames(io.BytesIO(archive(raw)), chunk)) == raw
    assert list(warc.frames(io.BytesIO(b""), chunk)) == []


def test_damaged_archives_are_refused():
    raw = warc.record(1, "u", b"payload", 7, warc.digest32(b"payload"), None, "d")
    good = archive([raw])
    for bad in (good[:-3], b"junk" + good, good + b"more", skippable(b"abc")[:-1], good[:10] + b"\x00" + good[11:]):
        with pytest.raises(warc.ArchiveError):
            for n, r in enumerate(warc.frames(io.BytesIO(bad))):
                warc.parse(r, n)
    for bad in (raw.replace(b"WARC/1.1", b"WARC/9.9"), raw.replace(b"payload", b"PAYLOAD"), raw[:-1], raw.replace(b"WARC-Date", b"No-Date"), raw.replace(b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(bad, 0)
    fields, http, payload = warc.parse(raw, 0)
    assert payload == b"payload" and fields["warc-type"] == "response" and http.startswith(b"HTTP/1.1 200")


def test_a_full_table_of_rows_goes_on_with_exact_rows():
    table = RowTable(lambda w: (float(len(w)), 1.0), 2, cap=8)
    r = random.Random(7)
    for _ in range(50):
        texts = [["x" * r.randint(1, 30) for _ in range(r.randint(0, 6))] for _ in range(4)]
        assert table.sums(texts).tolist() == [[float(sum(map(len, t))), float(len(t))] for t in texts]


def test_a_vocabulary_without_byte_pieces_is_completed(tmp_path):
    import sentencepiece

    words = tmp_path / "words.txt"
    words.write_text("a b ab\n" * 50)
    made = tmp_path / "own"
    sentencepiece.SentencePieceTrainer.train(input=str(words), model_prefix=str(made), vocab_size=8, hard_vocab_limit=False, model_type="bpe", minloglevel=2)
    got = lattice.first_lattice(f"{made}.model")
    assert sum(p.startswith("<0x") for p in got.pieces) == 256 and -1 not in got.bytes
    assert np.exp(got.logs[np.isfinite(got.logs)]).sum() + np.exp(got.end) == pytest.approx(1.0)
    assert got.log_marginal("é") < got.log_marginal("a") < 0
    with pytest.raises(ValueError, match="no pieces"):
        lattice.Lattice(["a"], np.log([0.5]), np.log(0.5)).log_marginal("b")


class _Known(dict):
    def __iter__(self):
        raise AssertionError("all that is known is gone through")


def test_new_parts_are_found_without_going_through_all_known_ones():
    """op8_training_order: a batch costs what it has, however much is known."""
    cache = PieceCache(public_tokenizers.path("byte_bpe_50k.tiktoken"), 2)
    cache.known = _Known()
    whole = PieceCache(public_tokenizers.path("byte_bpe_50k.tiktoken"), 2)
    for texts in (["one two three", None], ["two three four\nfive", "six two"]):
        assert cache.encode(texts) == whole.encode(texts)
