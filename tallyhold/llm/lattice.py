"""Language-model scores by a subword lattice: the marginal probability of a text over all its segmentations.

The pieces are those of an existing vocabulary (a SentencePiece model); only where that has no piece for some byte, one is
added, with the weight that byte pieces begin with. Its scores are the
first weights; expectation-maximisation over all training words then fits the pieces' probabilities. A word, with its
mark of a beginning, is a lattice of the pieces that occur in it; the log-space forward recursion sums the
probabilities of all paths. A text's probability is the product over its words, and of the end piece. A character that
the vocabulary lacks is spelt with its byte pieces. The base score is add-one smoothed and knows words only.

Scale. Words are counted in the map tasks, then by a shuffle of (word, count); everything else is done once for each
distinct word, not for each token. Each E-step sends one number a piece and task. To score the texts, words of frequency
at least ``t`` are broadcast, where t is the least power of two for which these are at most ``hot_words`` (a parameter,
so the size is bound); the others, none of which is frequent, are joined by a shuffle of (text, word, count).

Edge cases. Null and empty texts are the end alone; a very long text is scored whole, word by word. Without training texts the first weights stay and the base counts
are 0. Repeated rows are scored and learnt from each; other columns are never read; an empty table gives an empty
result. A word of any length is one lattice. Words as frequent as each other are all broadcast or none. ``docs`` must be a
table as read, so that its rows have the same numbers each time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhold.llm.common import crc_mod, small_batches, staged, tidy

MARK = "▁"
LN10 = math.log(10)
#: Up to so many characters a word's expected counts are first tried by plain products of probabilities.
LONG = 60
#: The first weight of a piece that spells one byte.
BYTE = 1e-4
#: A word below this probability is counted in log space: what a product above it loses to underflow is less than 1e-50 of it.
LEAST = 1e-250


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased: on bytes, lower and split know ASCII only."""
    return text.lower().split() if text else []


@dataclass
class Lattice:
    """Piece strings, their natural log probabilities, and that of the end."""

    pieces: list[str]
    logs: np.ndarray
    end: float

    def __post_init__(self) -> None:
        self.trie = ahocorasick.Automaton()
        self.bytes = [-1] * 256
        self.single: set[str] = set()
        for i, p in enumerate(self.pieces):
            if len(p) == 6 and p.startswith("<0x"):
                self.bytes[int(p[3:5], 16)] = i
            elif p:
                self.trie.add_word(p, (len(p), i))
                if len(p) == 1:
                    self.single.add(p)
        self.trie.make_automaton()
        self.value, self.likely = self.logs.tolist(), np.exp(self.logs).tolist()

    def __reduce__(self):
        return Lattice, (self.pieces, self.logs, self.end)

    def edges(self, word: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, end, piece ids) of all pieces in the marked word, by ascending end."""
        marked = MARK + word
        found = [(e + 1 - n, e + 1, (i,)) for e, (n, i) in self.trie.iter(marked)]
        lacking = [k for k, c in enumerate(marked) if c not in self.single]
        if lacking:
            found += [(k, k + 1, self._spelt(marked[k])) for k in lacking]
            found.sort(key=lambda x: x[1])
        return found

    def _spelt(self, char: str) -> tuple[int, ...]:
        ids = tuple(self.bytes[b] for b in char.encode())
        if -1 in ids:
            raise ValueError(f"no pieces for {char!r}, nor for its bytes")
        return ids

    def log_marginal(self, word: str) -> float:
        """Natural log of the sum over all segmentations of the product of their pieces' probabilities."""
        value, single, marked = self.value, self.single, MARK + word
        alpha = [-math.inf] * (len(marked) + 1)
        alpha[0] = 0.0
        exp, log1p = math.exp, math.log1p
        if single.issuperset(marked):
            steps = ((e + 1 - n, e + 1, value[i]) for e, (n, i) in self.trie.iter(marked))
        else:
            steps = ((s, e, sum(value[i] for i in ids)) for s, e, ids in self.edges(word))
        for s, e, v in steps:
            a, b = alpha[s] + v, alpha[e]
            if b < a:
                a, b = b, a
            alpha[e] = b + log1p(exp(a - b)) if a > -math.inf else b
        return alpha[-1]

    def expect(self, word: str, weight: float, into: list[float]) -> None:
        """Add the expected count of each piece in the word, times ``weight``: forward, then backward over its edges."""
        marked, n = MARK + word, len(word) + 1
        if n > LONG or not self.single.issuperset(marked):
            self._expect_long(self.edges(word), n, weight, into)
            return
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        alpha[0] = beta[n] = 1.0
        likely, found = self.likely, []
        for e, (k, i) in self.trie.iter(marked):
            e += 1
            s = e - k
            p = likely[i]
            alpha[e] += alpha[s] * p
            found.append((s, e, p, i))
        if not alpha[n] >= LEAST:
            self._expect_long(self.edges(word), n, weight, into)
            return
        # by descending end: all edges that begin where an edge ends have been seen
        weight /= alpha[n]
        for s, e, p, i in reversed(found):
            p *= beta[e]
            beta[s] += p
            into[i] += alpha[s] * p * weight

    def _expect_long(self, edges: list, n: int, weight: float, into: list[float]) -> None:
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        values = [sum(self.value[i] for i in ids) for _, _, ids in edges]
        for (s, e, _), v in zip(edges, values, strict=True):
            alpha[e] = np.logaddexp(alpha[e], alpha[s] + v)
        for k in sorted(range(len(edges)), key=lambda k: -edges[k][0]):
            s, e, _ = edges[k]
            beta[s] = np.logaddexp(beta[s], beta[e] + values[k])
        for (s, e, ids), v in zip(edges, values, strict=True):
            share = weight * math.exp(alpha[s] + v + beta[e] - alpha[n])
            for i in ids:
                into[i] += share


def first_lattice(path: str | None = None) -> Lattice:
    """The vocabulary with its own scores as weights: a piece of rank r (its score is -r) weighs 1 / (r + 10)."""
    own = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces, weight = [], []
    for i in range(own.get_piece_size()):
        usable = not (own.is_control(i) or own.is_unknown(i) or own.is_unused(i))
        piece = own.id_to_piece(i)
        # a mark inside a piece would join words, which a lattice of one word never holds
        pieces.append(piece if usable and MARK not in piece[1:] else "")
        weight.append(0.0 if not pieces[-1] else BYTE if own.is_byte(i) else 1.0 / (10.0 - own.get_score(i)) if own.get_score(i) > -1e8 else 1e-6)
    lacking = [x for x in (f"<0x{b:02X}>" for b in range(256)) if x not in pieces]
    pieces += lacking
    weight += [BYTE] * len(lacking)
    w = np.array(weight)
    w /= w.sum() * (1 + 1e-3)
    with np.errstate(divide="ignore"):
        return Lattice(pieces, np.log(w), math.log(1e-3 / (1 + 1e-3)))


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, flush: int = 250_000) -> DataFrame:
    """word, n_train, n_all: counts in the training rows (crc32 mod ``mod`` isn't 2) and in all rows; staged."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for n, counter in zip((0, 1), seen, strict=True):
                words, counts = list(counter), np.fromiter(counter.values(), np.int64, len(counter))
                for i in range(0, len(words), 50_000):
                    part = counts[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()).cast(pa.string()), pa.array(part * n, pa.int64()), pa.array(part, pa.int64())], names=["word", "n_train", "n_all"])
                counter.clear()

        for b in small_batches(batches):
            for train, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[train].update(words_of(text))
            if len(seen[0]) + len(seen[1]) > flush:
                yield from out()
        yield from out()

    rows = docs.select((crc_mod(F.col(id_col), mod) != 2).cast("int").alias("train"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(run, "word string, n_train long, n_all long")
    return staged(found.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")), "words")


def fit(counts: DataFrame, train_docs: int, start: Lattice, *, rounds: int = 3, smooth: float = 0.1) -> Lattice:
    """Expectation-maximisation over all training words; ``smooth`` is added to each piece's count."""
    spark, now = counts.sparkSession, start
    if not train_docs:
        return start
    words = counts.where("n_train > 0").select("word", "n_train")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            sums = [0.0] * len(own.pieces)
            for b in batches:
                for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own.expect(word, float(n), sums)
            total = np.array(sums)
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.float64())], names=["piece", "n"])

        got = words.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        usable = np.isfinite(start.logs)
        expected = np.where(usable, smooth, 0.0)
        for r in got:
            expected[r.piece] += r.n
        whole = expected.sum() + train_docs
        with np.errstate(divide="ignore"):
            now = Lattice(start.pieces, np.log(expected / whole), math.log(train_docs / whole))
        sent.destroy()
    return now


def score(docs: DataFrame, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rounds: int = 3, hot_words: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    counts = count_words(docs, id_col=id_col, text_col=text_col, mod=mod)
    train_docs = docs.where(crc_mod(F.col(id_col), mod) != 2).count()
    sums = counts.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum((F.col("n_train") > 0).cast("long")), F.lit(0))).first()
    total, kinds = sums[0] + train_docs, sums[1] + (train_docs > 0)
    lattice = fit(counts, train_docs, first_lattice(vocabulary), rounds=rounds)
    sent = spark.sparkContext.broadcast(lattice)

    @tidy
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            logs = [own.log_marginal(w) / LN10 for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(logs, pa.float64())], names=["word", "n_train", "n_all", "logp"])

    known = staged(counts.mapInArrow(weigh, "word string, n_train long, n_all long, logp double"), "word-scores")
    size = F.floor(F.log2("n_all")).cast("int")
    least, held = 0, 0
    for bits, n in sorted(((r[0], r[1]) for r in known.groupBy(size.alias("bits")).count().collect()), reverse=True):
        if held + n > hot_words:
            least = bits + 1
            break
        held += n
    hot = known.where(F.col("n_all") >= 2**least).collect()
    # no word has a space in it
    table = spark.sparkContext.broadcast((" ".join(r.word for r in hot).encode(), np.array([(math.log10(r.n_train + 1), r.logp, float(r.n_train > 0)) for r in hot], np.float64).reshape(-1, 3)))
    del hot

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_held, values = table.value
        ids = {w: i for i, w in enumerate(words_held.split())}
        for b in small_batches(batches, 256):
            uid, word, n, sums, doc = [], [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = words_of(text)
                at = [ids.get(w, -1) for w in words]
                rows = np.array(at, np.int64)
                got = values[rows[rows >= 0]].sum(0)
                cold = Counter(w for w, i in zip(words, at, strict=True) if i < 0)
                uid += [key] * (len(cold) + 1)
                # a text's own row meets no word, and lies where its key sends it
                word += [b" %d" % key, *cold]
                n += [len(words) + 1, *cold.values()]
                sums += [got, *([np.zeros(3)] * len(cold))]
                doc += [True, *([False] * len(cold))]
            sums = np.array(sums).reshape(-1, 3)
            keys = pa.array(uid, pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), *(pa.array(sums[:, k]) for k in range(3)), pa.array(doc, pa.bool_())], names=["uid", "word", "n", "base", "logp", "known", "own"])

    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    parts = texts.mapInArrow(meet, "uid long, word string, n long, base double, logp double, known double, own boolean")
    cold = known.where(F.col("n_all") < 2**least).select("word", F.log10(F.col("n_train") + 1).alias("w_base"), F.col("logp").alias("w_logp"), (F.col("n_train") > 0).cast("double").alias("w_known"))
    parts = parts.join(cold, "word", "left")

    def whole(of: str) -> Column:
        return F.sum(F.when(F.col("own"), F.col(of)).otherwise(F.col("n") * F.col(f"w_{of}"))).alias(of)

    got = parts.groupBy("uid").agg(F.max(F.when(F.col("own"), F.col("n"))).alias("n_tokens"), whole("base"), whole("logp"), whole("known"))
    out = texts.select("uid", "doc_id").join(got, "uid")
    per_token, end = math.log10(total + kinds + 1), math.log10(train_docs + 1)
    return out.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), mod) == 2).alias("held_out"),
        "n_tokens",
        (F.round("known").cast("long") + F.lit(int(train_docs > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("logp") + F.lit(lattice.end / LN10)).alias("score"),
    )
