"""Every operator over odd and empty tables, against the plain versions in brute.py."""

import os
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyhold.llm import common, decontaminate, langid, lattice, lines, packing, repeats, setjoin, shards, toxicity, warc

LABELS = "doc_id long, quality int, toxic int, text string"


def labels(spark, rows):
    return spark.createDataFrame(rows, LABELS)


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_toxicity(spark, odd):
    rows, docs = odd
    marks = labels(spark, [(i, 1, int(i % 2), "x") for i, _ in rows] + [(7, 1, None, ""), (7, 1, 0, "")])
    got = toxicity.classify(docs, marks).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == brute.held(r.doc_id, 4) for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2, 17)}) == 1


def test_toxicity_scores_are_those_of_a_plain_pass(spark, odd):
    rows, docs = odd
    marks = labels(spark, [(i, 1, int(i % 2), "x") for i, _ in rows])
    model = toxicity.train(docs, marks)
    assert model.weight.any()
    want = sorted((i, brute.op1(t, model)) for i, t in rows)
    got = sorted((r.doc_id, r.score) for r in toxicity.score(docs, model).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-6)


def test_toxicity_without_labels_or_rows(spark, odd, empty):
    rows, docs = odd
    assert [r.score for r in toxicity.classify(docs, labels(spark, [])).collect()] == pytest.approx([1e-6] * len(rows))
    assert all(r.score > 0.99 for r in toxicity.classify(docs, labels(spark, [(i, 1, 1, "") for i, _ in rows])).collect())
    assert toxicity.classify(empty, labels(spark, [(1, 1, 1, "")])).isEmpty()


def test_lines(odd, empty):
    rows, docs = odd
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = brute.op2(rows)
    assert tuples(lines.measure(docs), *names) == sorted(((i, *want[i]) for i, _ in rows), key=str)
    kept = {r.doc_id: r.kept for r in lines.measure(docs).collect()}
    assert kept[6] and kept[7] and not kept[0] and not kept[18] and not kept[19]
    assert lines.measure(empty).isEmpty()


def test_warc(spark, tmp_path, empty):
    pages = [(1, "http://a/ b\r\n", "<p>é"), (2, None, "<p>é"), (3, "u", None), (4, "u", ""), (9, "u", "x" * 300_000), (5, "u", "other"), (5, "u", "other"), (0, "u", "<p>é")]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    df.write.parquet(str(tmp_path / "pages"))
    files = warc.write(spark.read.parquet(str(tmp_path / "pages")), f"file://{tmp_path}/out")
    got = warc.read(spark, files)
    want = brute.op3([(p, h) for p, _, h in pages])
    assert tuples(warc.digest(got), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    by = {(r.page_id, r.record_type): r for r in got.collect()}
    assert bytes(by[0, "response"].payload).decode() == "<p>é" and by[1, "revisit"].payload is None and by[1, "revisit"].url == "http://a/%20b%0D%0A" and by[2, "revisit"].url is None
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(spark, warc.write(none, f"file://{tmp_path}/none")).isEmpty()
    # the two empty payloads are too short to be revisits
    assert warc.plan_records(spark.read.parquet(str(tmp_path / "pages")), least_bytes=5).where("is_first").count() == 5


def test_warc_beyond_its_bounds(spark, tmp_path, monkeypatch):
    """Revisits that meet the pages by a shuffle, and salts of few rows."""
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(warc, "ROWS_A_SALT", 5)
    pages = [(k, "u", "all the same" if k % 3 else f"own {k // 6}") for k in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).write.parquet(str(tmp_path / "p"))
    got = warc.read(spark, warc.write(spark.read.parquet(str(tmp_path / "p")), f"file://{tmp_path}/out"))
    assert tuples(warc.digest(got), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute.op3([(p, h) for p, _, h in pages])


def test_archives_of_others(spark, tmp_path):
    def raw(kind, number, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{number}>", "WARC-Date: 2024-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    records = [
        raw("warcinfo", 1, b"software: x\r\n", "Content-Type: application/warc-fields"),
        raw("request", 2, b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        raw("response", 3, http + b"<p>", "Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://a/"),
        raw("resource", 4, b"plain\r\n\r\ntext", "Content-Type: text/plain", "WARC-Payload-Digest: md5:abc"),
        raw("revisit", 5, http, "Content-Type: application/http", "WARC-Refers-To: <urn:uuid:3>", f"WARC-Payload-Digest: sha1:{warc.digest32(b'<p>')}"),
    ]
    packer = zstandard.ZstdCompressor()
    (tmp_path / "a.warc.zst").write_bytes(b"".join(map(packer.compress, records)))
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst",)], "file string")
    got = warc.read(spark, files).orderBy("record").collect()
    assert [(r.record_type, r.record_id, r.page_id, None if r.payload is None else bytes(r.payload)) for r in got] == [
        ("warcinfo", "<urn:uuid:1>", None, b"software: x\r\n"), ("request", "<urn:uuid:2>", None, b""), ("response", "<urn:uuid:3>", None, b"<p>"), ("resource", "<urn:uuid:4>", None, b"plain\r\n\r\ntext"), ("revisit", "<urn:uuid:5>", None, None),
    ]
    assert [r.payload_digest for r in got[:3]] == [None] * 3 and got[3].payload_digest == "abc" and got[4].refers_to_id == "<urn:uuid:3>" and got[4].payload_bytes is None and got[2].url == "http://a/"
    (tmp_path / "a.warc.zst").write_bytes(packer.compress(raw("response", 6, http + b"x", "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{warc.digest32(b'y')}")))
    with pytest.raises(Exception, match="another digest"):
        warc.read(spark, files).collect()


@pytest.mark.parametrize("block", [None, 2000])
def test_decontamination(spark, odd, empty, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows, docs = odd
    texts = dict(rows)
    items = [(1, texts[7]), (2, " ".join(texts[6].split()[100:130])), (3, "One"), (4, None), (5, ""), (6, texts[11][:200].upper()), (6, texts[12][:120]), (7, "the same line. the same line"), (8, "no such words anywhere at all here my dear friend ever")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, term int")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")
    want = [(*r, n) for r, n in zip(brute.op4_rows(rows, items), brute.op4_near(rows, items), strict=True)]
    assert tuples(decontaminate.digest(decontaminate.hits(docs, bench)), *names) == sorted(want, key=str)
    assert decontaminate.hits(empty, bench).isEmpty()
    none = decontaminate.hits(docs, bench.where("false")).collect()
    assert len(none) == len(rows) and not any(r.contaminated or r.item_ids or r.near_ids for r in none)


def test_items_without_an_id_hit_but_have_no_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "b c d"), (None, "b c d e f")], "item_id long, text string")
    got = decontaminate.hits(docs, items).orderBy("doc_id").collect()
    assert [(r.n_hit, r.item_ids, r.contaminated) for r in got] == [(3, [], True), (0, [], False)]


def test_lists_of_the_index(odd):
    rows, docs = odd
    got = decontaminate.build_index(docs).collect()
    assert sorted((r.doc_id, r.words) for r in got) == sorted((i, brute.ALNUM.findall(brute.lower(t))) for i, t in rows)
    for r in got:
        lists = {r.words[r.places[a]]: r.places[a:b] for a, b in zip(r.opens, [*r.opens[1:], r.n_words], strict=True)} if r.opens else {}
        assert len(lists) == len(r.opens) and lists == {w: [k for k, x in enumerate(r.words) if x == w] for w in set(r.words)}


def near_of(docs, items, **how):
    index = decontaminate.build_index(docs)
    return [(r.doc_id, r.item_id, r.pos) for r in decontaminate.near(index, items, **how).join(index.select("uid", "doc_id"), "uid").collect()]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x green x x blue"), (2, "red " + "x " * 50 + "green blue"), (3, "green blue")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    assert [i for i, _, _ in near_of(docs, items, span=6)] == [1]


def test_proximity_of_copies_and_of_lacking_terms(spark):
    far = "red " + "x " * 30 + "green " + "x " * 30 + "blue"
    docs = spark.createDataFrame([(1, "x x " + far + " x"), (2, "x " * 9), (3, "x " * 9), (4, "red " + "x " * 70 + "green blue"), (5, "pink grey")], "doc_id long, text string")
    items = spark.createDataFrame([(1, far), (2, "pink grey lacking")], "item_id long, text string")
    assert near_of(docs, items) == [(1, "1", 64)]


def test_language(spark, odd, empty):
    rows, docs = odd
    got = {(r.doc_id, r.lang_pred, r.score, r.held_out) for r in langid.identify(docs).collect()}
    assert {i for i, *_ in got} == {i for i, _ in rows}
    for i, lang, score, held in got:
        assert 0 <= score <= 1 and held == brute.held(i, 4) and lang in ("en", "fr", "und")
        assert (lang == "und") == (not any(map(str.isalpha, dict(rows)[i] or "")))
    assert langid.identify(empty).isEmpty()
    assert {r.lang_pred for r in langid.identify(docs.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


def test_languages_are_those_of_a_plain_decoding(odd):
    rows, docs = odd
    model = langid.train(docs)
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect())
    want = sorted((i, *brute.op5(t, model)) for i, t in rows)
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-5)
    # a bound on all rows, not on each language's
    assert len(langid.train(docs, most=2).langs) <= 2


def ids_of(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]


@pytest.mark.parametrize("size", [2048, 64, 7])
def test_packing(odd, empty, size):
    rows, docs = odd
    want, pieces, windows = sorted(ids_of(rows)), defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, size=size).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length
        pieces[r.doc_id].append((r.start, ids, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [0, *np.cumsum([n for _, n in w])[:-1].tolist()] and sum(n for _, n in w) <= size
    total = sum(len(ids) for _, ids in want)
    assert len(windows) * size - total <= 3 * size
    for i in {i for i, _ in want}:
        # rows that share an id are equal here, so their pieces can be told apart by multiplicity only
        copies = [ids for k, ids in want if k == i]
        assert sorted(x for _, ids, _ in pieces[i] for x in ids) == sorted(x for ids in copies for x in ids)
        assert all(ids == copies[0][s : s + len(ids)] and n == len(copies[0]) for s, ids, n in pieces[i])
    assert packing.pack(empty).isEmpty()


def test_packing_takes_the_level_of_the_least_sum():
    p = packing.Packer(16)
    r = np.random.default_rng(3)
    for _ in range(300):
        p.count[:] = r.integers(0, 4, 17) * (r.random(17) < 0.5)
        p.count[0] = p.count[16] = 0
        n = int(r.integers(1, 16))

        def cost(at, n=n):
            c = p.count.copy()
            c[at] -= at > 0
            c[at + n] += at + n < 16
            return int((c**2).sum())

        usable = [h for h in range(16 - n + 1) if h == 0 or p.count[h]]
        assert cost(p.level(n)) == min(map(cost, usable))


def test_packing_bounds_what_is_open():
    """Documents of which no two fit into one window: whole windows come out while they are packed, and none is lost."""
    p, seen = packing.Packer(2048, 100), 0
    for k in range(3000):
        p.add(k, np.full(1100, k, "<u4").tobytes())
        seen = max(seen, p.n_open)
    assert seen <= 100 and p.full and sum(p.count) == p.n_open == sum(map(len, p.open.values()))
    p.close()
    got = defaultdict(list)
    for w in p.full:
        assert sum(len(ids) for _, _, ids, _ in w) <= 2048 * 4
        for k, start, ids, total in w:
            assert total == 1100 and np.frombuffer(ids, "<u4").tolist() == [k] * (len(ids) // 4)
            got[k] += range(start, start + len(ids) // 4)
    assert all(sorted(got[k]) == list(range(1100)) for k in range(3000)) and len(p.full) == -(-3000 * 1100 // 2048)


def test_packing_digest(odd):
    rows, docs = odd
    by = dict(ids_of(rows))
    for r in packing.digest(packing.pack(docs)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(by[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


@pytest.mark.parametrize("how", [{}, {"block_bytes": 2000, "bucket_rows": 60}, {"hot_level": 1, "bucket_rows": 60}])
def test_set_join(odd, empty, how):
    rows, docs = odd
    assert tuples(setjoin.components(docs, **how), "doc_id", "n_shingles", "component_id") == sorted(brute.op7(rows), key=str)
    assert setjoin.components(empty).isEmpty()


def test_components_of_a_long_chain_a_star_and_two_hubs(spark):
    r = np.random.default_rng(5)
    name = r.permutation(2000).tolist()
    pairs = [(name[k], name[k + 1]) for k in range(600)] + [(name[700], name[k]) for k in range(701, 900)] + [(name[k], name[901 + k % 2]) for k in range(1000, 1100)] + [(name[901], name[902]), (name[3], name[3])]
    got = setjoin._stars(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()
    top = {}
    for part in (name[:601], name[700:900], [*name[901:903], *name[1000:1100]]):
        top |= {x: min(part) for x in part if x != min(part)}
    assert {x.a: x.b for x in got} == top and len(got) == len(top)
    assert setjoin._stars(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_sets_linked_to_a_lead_join_what_is_larger_apart():
    """b is in the first component apart, a larger one than the lead's, and only a, linked to the lead, links them."""
    head, a, b, first, more = (np.arange(k, k + 100, dtype=np.uint64) for k in (0, 10, 22, 36, 40))
    got = list(setjoin._joining(0, [(1, a)], [(3, first), (2, b), (4, more), (5, more[1:])], 75))
    assert {frozenset(x) for x in got} & {frozenset((1, 2))} and (1, 1) not in got
    r = np.random.default_rng(3)
    for _ in range(300):
        sets = [np.arange(k, k + 40, dtype=np.uint64) for k in r.integers(0, 60, r.integers(2, 14)).tolist()]
        near = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 100 * (n := setjoin.overlap(x, y)) >= 75 * (80 - n)}
        linked = [k for k in range(1, len(sets)) if (0, k) in near]
        apart = [k for k in range(1, len(sets)) if (0, k) not in near]
        found = set(setjoin._joining(0, [(k, sets[k]) for k in linked], [(k, sets[k]) for k in apart], 75))
        assert {(min(x), max(x)) for x in found} <= near
        whole, own = setjoin._Joined(), setjoin._Joined()
        for x in near:
            whole.join(*x)
        for x in found | {(0, k) for k in linked}:
            own.join(*x)
        assert all((whole.find(i) == whole.find(j)) == (own.find(i) == own.find(j)) for i in range(len(sets)) for j in range(i))


@pytest.mark.parametrize("cells", [4, 8])
def test_a_small_table_of_levels_changes_no_result(odd, monkeypatch, cells):
    rows, docs = odd
    monkeypatch.setattr(setjoin, "CELL_BITS", cells)
    monkeypatch.setattr(setjoin, "CELLS", 1 << cells)
    monkeypatch.setattr(setjoin, "BROADCAST_BYTES", 0)
    assert tuples(setjoin.components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.op7(rows), key=str)


def test_ranks_hold_beyond_the_table_of_levels(spark, tmp_path, monkeypatch):
    """however few cells there are, shingles that repeat aren't listed before those that no other set has."""
    r = np.random.default_rng(8)
    shared = [" ".join(f"s{k}x{j}" for j in range(8)) for k in range(60)]
    rows = [(k, " ".join([*(f"d{k}x{j}" for j in range(40)), *(shared[i] for i in r.integers(0, 60, 3))])) for k in range(80)] + [(90, ""), (91, None), (92, "d0x0 d0x1")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    docs, made, own = spark.read.parquet(path), [], setjoin._leads
    monkeypatch.setattr(setjoin, "_leads", lambda postings: made.append(own(postings)) or made[-1])
    for cells in (20, 4):
        monkeypatch.setattr(setjoin, "CELL_BITS", cells)
        monkeypatch.setattr(setjoin, "CELLS", 1 << cells)
        assert tuples(setjoin.components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.op7(rows), key=str)
    whole, few = (x.count() for x in made)
    assert few <= whole


def test_counted_shingles_and_shuffles_leave_the_disk(spark, odd):
    places = []
    own = setjoin.staged

    def staged(df, name, **how):
        places.append((name, (got := own(df, name, **how)).staged_at.removeprefix("file://")))
        return got

    setjoin.staged, key = staged, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        setjoin.components(odd[1])
    finally:
        setjoin.staged = own
    assert [x for x in os.listdir(dict(places)["sets"]) if x.startswith("counted")] == ["counted=false"]
    assert spark.conf.get(key, None) == before


def test_sets_that_share_an_id_are_told_apart(odd, monkeypatch):
    rows, docs = odd
    own = setjoin.identity
    # with the first seed all ids are among seven
    monkeypatch.setattr(setjoin, "identity", lambda tokens, seed=0: (own(tokens)[0] % 7, own(tokens)[1]) if not seed else own(tokens, seed))
    assert tuples(setjoin.components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.op7(rows), key=str)


def test_one_of_each_set_component_stays(spark, tmp_path):
    own = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(12)]
    chain = [" ".join(f"c{j}" for j in range(k, k + 60)) for k in range(0, 60, 5)]
    rows = [(None, t) for t in own[:4]] + [(5, t) for t in own[4:8]] + [(6, own[8]), (7, own[9]), (None, own[9]), (None, own[10]), (None, own[10])]
    rows += [(None, t) for t in chain[:-1]] + [(9, chain[-1]), (None, ""), (None, None), (5, "")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    want = [(None, t) for t in own[:4]] + [(5, t) for t in own[4:8]] + [(6, own[8]), (7, own[9]), (None, own[10]), (9, chain[-1]), (None, ""), (None, None), (5, "")]
    assert sorted(map(tuple, setjoin.first_of_each(docs).collect()), key=str) == sorted(want, key=str)
    named = {}
    for uid, i in ((r.uid, r.component_id) for r in setjoin.components(docs).where("n_shingles = 56").collect()):
        named[uid] = i
    assert len(named) == len(chain) and set(named.values()) == {9}


def test_subsets_and_prefixes_miss_no_link():
    r = np.random.default_rng(1)
    light = setjoin.boundary(75, 0.1)
    assert 3 < light < 40
    some = r.integers(0, 2**63, 30, dtype=np.uint64)
    for _ in range(2000):
        a = np.unique(r.choice(some, r.integers(1, 12)))
        b = np.unique(np.r_[a[r.random(len(a)) < 0.9], r.choice(some, r.integers(0, 2))])
        if not len(b):
            continue
        both = setjoin.overlap(a, b)
        linked = 100 * both >= 75 * (len(a) + len(b) - both)
        shared = set(setjoin.subset_keys(a, 75, 40)) & set(setjoin.subset_keys(b, 75, 40))
        if linked:
            assert shared
            assert both >= setjoin.least_overlap(len(a), len(b), 75)
            assert set(a[: setjoin.prefix(len(a), 75)].tolist()) & set(b[: setjoin.prefix(len(b), 75)].tolist())


@pytest.mark.parametrize("how", [{}, {"size": 24, "gram": 8, "bucket_bytes": 20_000, "chunk": 2000}, {"hot": 2}, {"size": 24, "gram": 8, "hot": 3}])
def test_repeats(odd, empty, how):
    rows, docs = odd
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert tuples(repeats.digest(repeats.remove(docs, **how)), *names) == sorted(brute.op9(rows, how.get("size", 200)), key=str)
    assert repeats.remove(empty).isEmpty()


def test_repeats_and_removals_by_shuffle(spark, odd, monkeypatch):
    """The plans of tables too large to be broadcast."""
    rows, docs = odd
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert tuples(repeats.digest(repeats.remove(docs)), *names) == sorted(brute.op9(rows), key=str)
    gone = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id").where("doc_id % 2 = 0").select("uid")
    for most in (0, 1_000_000):
        left = common.without(docs, gone, at_most=most)
        assert left.schema == docs.schema and tuples(left, "doc_id", "text") == sorted(((i, x) for i, x in rows if i % 2), key=str)


def test_many_copies_in_one_task_are_settled_there(spark, tmp_path):
    r = np.random.default_rng(8)
    passage = bytes(r.integers(97, 123, 400, dtype=np.uint8)).decode()
    rows = [(k, bytes(r.integers(97, 123, 150, dtype=np.uint8)).decode() + (passage if k % 2 else passage[: 150 + k]) + "z" * (k % 5)) for k in range(120)]
    rows += [(200 + k, passage * 2) for k in range(30)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
    want = sorted(brute.op9(rows), key=str)
    for hot in (5, 20_000):
        assert tuples(repeats.digest(repeats.remove(spark.read.parquet(path), hot=hot)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        pass

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_staged_tables_can_be_dropped(spark):
    one = common.staged(spark.range(3), "own")
    assert one.count() == 3
    common.dropped(one)
    assert not os.path.exists(one.staged_at.removeprefix("file://"))


def test_shards(spark, odd, empty, tmp_path):
    rows, docs = odd
    got = sorted(shards.materialise(docs, f"file://{tmp_path}/s", size=32, per_shard=20).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got))) and all(r.shard == r.slot // 20 and r.byte_offset == r.slot % 20 * 64 for r in got)
    held = []
    for k in range(got[-1].shard + 1):
        records = shards.read(f"file://{tmp_path}/s", k, 0, 20, size=32)
        held += [x.tolist() for x in records]
        late = shards.read(f"file://{tmp_path}/s", k, 2, 3, size=32)
        assert (late == records[2:5]).all()
    assert len(held) == len(got)
    for ids, r in zip(held, got, strict=True):
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u2").tobytes()) and not any(ids[r.n_tokens :])
    kept = sorted(x for ids, r in zip(held, got, strict=True) for x in ids[: r.n_tokens])
    assert kept == sorted(x for _, ids in ids_of(rows) for x in ids)
    again = shards.materialise(docs, f"file://{tmp_path}/t", size=32, per_shard=20).collect()
    assert sorted(again, key=lambda r: r.slot) == got
    assert shards.materialise(empty, f"file://{tmp_path}/e").isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_feistel_permutes(n):
    p = shards.Feistel(n, b"k")(np.arange(n))
    assert sorted(p.tolist()) == list(range(n))
    if n == 1000:
        assert (p != shards.Feistel(n, b"other")(np.arange(n))).any() and abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.2


def test_lattice_scores(spark, odd, empty):
    rows, docs = odd
    for hot in (300_000, 50):
        got = lattice.score(docs, hot_words=hot).collect()
        want = brute.op10_base(rows)
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
        for r in got:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and r.base_score == pytest.approx(want[r.doc_id][4])
            assert np.isfinite(r.score) and r.score < 0
    assert lattice.score(empty).isEmpty()
    few = [(i, t) for i, t in rows if i != 6]
    want = brute.op10(few, lattice.first_lattice())
    for r in lattice.score(docs.where("doc_id <> 6"), hot_words=50).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9)
    only_held = docs.where("doc_id in (%s)" % ",".join(str(i) for i, _ in rows if brute.held(i, 7)))
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and np.isfinite(r.score) for r in lattice.score(only_held).collect())
