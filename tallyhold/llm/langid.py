"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword of bits, far from every other codeword. For each bit a binary classifier
(logistic regression over the shares of hashed n-grams of one to three characters) is trained to tell the
languages whose bit is 1 from the others. A text gets one margin per bit; loss-weighted decoding sums, for each
codeword, the logistic losses of the margins against its bits, each weighted by how well that bit's classifier
does on that language in training, and chooses the least. ``ambiguous`` marks texts whose two least losses are
closer than ``margin``.

Scale. A bounded sample of labelled rows is learnt from (``per_lang`` of each language and ``most`` in all, parameters, in the
mean), drawn by a hash of doc_id from the whole table. The model is buckets x bits floats, bound by parameters.
Prediction is one scan with no shuffle; the margins of a text are sums over its words, so a word's n-grams are
hashed once for each task.

Edge cases. Null texts, empty ones and texts without a letter give ``und`` with the score 1 and no ambiguity. A very long text is
read whole: its margins are means over all of its n-grams. Null
languages are not learnt from. With no labelled row every text is ``und`` with the score 0; with one language
every text with a letter gets it, with the score 1. Repeated rows are predicted each; other columns are never
read; an empty table gives an empty result. Equal losses go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhold.llm.common import RowTable, crc_mod, hash_share, small_batches, tidy
from tallyhold.llm.subword import Bags, gram_ids, words_of


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of bits: all splits in two for up to five classes, else the best of seeded random codes.

    No column is constant, no two columns are equal or complements, no two rows are equal.
    """
    if n <= 1:
        return np.zeros((n, 1), np.int8)
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[(s >> (n - 1 - r)) & 1 if r else 0 for s in splits] for r in range(n)], np.int8)
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(200):
        code = rng.integers(0, 2, (n, bits), dtype=np.int8)
        apart = (code[:, None, :] != code[None]).sum(2) + bits * np.eye(n, dtype=int)
        if code.any(0).all() and (~code.astype(bool)).any(0).all() and (best is None or apart.min() > best[0]):
            best = (apart.min(), code)
    return best[1]


@dataclass(frozen=True)
class LangModel:
    langs: list[str]
    code: np.ndarray
    trust: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    low: int
    high: int
    margin: float

    def word(self, word: str) -> tuple:
        ids = gram_ids(word, self.low, self.high, len(self.weight))
        return (*self.weight[ids].sum(0), float(len(ids)))

    def margins(self, table: RowTable, texts: list[str | None]) -> np.ndarray:
        sums = table.sums([words_of(t) for t in texts])
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1.0) + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score, ambiguous."""
        signs = 2.0 * self.code - 1
        loss = np.stack([(np.logaddexp(0, -margins * s) * t).sum(1) for s, t in zip(signs, self.trust, strict=True)], 1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)) * self.code.shape[1])
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        two = np.sort(loss, 1)[:, :2]
        return best, share[np.arange(len(best)), best], (two[:, 1] - two[:, 0] < self.margin) if loss.shape[1] > 1 else np.zeros(len(best), bool)


def fit(texts: list[str | None], langs: list[str], *, low: int = 1, high: int = 3, buckets: int = 1 << 15, epochs: int = 10, rate: float = 0.5, batch: int = 128, scale: float = 20.0, margin: float = 0.1, seed: int = 5) -> LangModel:
    """Train one binary classifier for each bit of the code of the languages in ``langs``."""
    names = sorted(set(langs))
    code = codewords(len(names))
    bits = code.shape[1]
    weight, bias = np.zeros((buckets, bits), np.float32), np.zeros(bits, np.float32)
    trust = np.full((max(1, len(names)), bits), 1.0 / bits)
    if len(names) > 1:
        y = np.searchsorted(names, langs)
        want = code[y].astype(np.float32)
        balance = (len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y].astype(np.float32)
        rng, bags = np.random.default_rng(seed), Bags(texts, low, high, buckets, 2)
        squares, squares_bias = np.full((buckets, 1), 1e-6, np.float32), np.full(bits, 1e-6, np.float32)
        for _ in range(epochs):
            for rows, cols, x in bags.batches(batch, rng):
                x *= scale
                p = 1 / (1 + np.exp(-np.clip(x @ weight[cols] + bias, -30, 30)))
                off = (p - want[rows]) * (balance[rows] / len(rows))[:, None]
                grad, grad_bias = x.T @ off, off.sum(0)
                squares[cols] += (grad**2).mean(1, keepdims=True)
                weight[cols] -= rate * grad / np.sqrt(squares[cols])
                squares_bias += grad_bias**2
                bias -= 0.1 * grad_bias / np.sqrt(squares_bias)
        weight *= scale
        right = np.zeros((len(names), bits))
        for i, (ids, share) in enumerate(zip(bags.ids, bags.share, strict=True)):
            right[y[i]] += ((share @ weight[ids] + bias) > 0) == code[y[i]]
        trust = right / np.maximum(np.bincount(y, minlength=len(names)), 1)[:, None] + 1e-3
        trust /= trust.sum(1, keepdims=True)
    return LangModel(names, code, trust, weight, bias, low, high, margin)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1200, most: int = 60_000, seed: int = 5) -> LangModel:
    """Fit on about ``per_lang`` rows of each non-null language outside the held-out remainder (crc32 mod 4 is 2), and on about
    ``most`` in all: where there are many languages, each has fewer."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & (crc_mod(F.col("id"), 4) != 2))
    count = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not count:
        return fit([], [], seed=seed)
    share, per_lang = F.lit(0.0), min(per_lang, most / len(count))
    for lang, n in count.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))).otherwise(share)
    chosen = rows.where(hash_share(F.col("id"), seed) < share).collect()
    return fit([r.text for r in chosen], [r.lang for r in chosen], seed=seed)


def predict(docs: DataFrame, model: LangModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        seen = RowTable(own.word, own.weight.shape[1] + 1)
        for b in small_batches(batches):
            texts = b.column(1).to_pylist()
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
            if own.langs:
                best, score, close = own.decode(own.margins(seen, texts))
                lang = [own.langs[i] if ok else "und" for i, ok in zip(best, letters, strict=True)]
                score, close = np.where(letters, score, 1.0), close & letters
            else:
                lang, score, close = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def identify(docs: DataFrame, **how) -> DataFrame:
    """Train on the rows of ``docs`` that have a language and predict all of it."""
    return predict(docs, train(docs, **how))
