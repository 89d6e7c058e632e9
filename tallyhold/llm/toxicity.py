"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the mean of the vectors of all its words and of all their character n-grams (hashed to a fixed
number of buckets); a linear softmax over that mean gives the probability of the toxic label. Vectors and
softmax are trained together by Adagrad. A misspelt word that training never saw shares most of its n-grams,
and so most of its vector, with the word it stands for.

Scale. Training uses a bounded sample of labelled rows (``per_label`` of each label, a parameter), chosen by a
hash of doc_id over the whole table; its ids are the only thing joined, and broadcast, so the bound holds for
any corpus. The model that goes to the executors is one float for each bucket (the vector times the
difference of the softmax's columns), because a mean followed by a linear map is a sum over words. Scoring is one
scan with no shuffle; each new word costs its n-grams once for each task, each further one a dictionary look-up.

Edge cases. Null and empty texts have the score of the bias alone. A very long text is read whole: the mean is over all of its
words. A score that equals the threshold is predicted toxic. Null or missing labels are not learnt from;
of several labels of one document the largest counts. With no labelled row, or with one label only, the score
of every text is the share of label 1, a millionth off 0 and 1 at least. Repeated rows are scored each. Columns other than the
key and the text pass through unread, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.llm.common import RowTable, crc_mod, hash_share, tidy
from tallyhold.llm.subword import Bags, gram_ids, words_of


@dataclass(frozen=True)
class Toxicity:
    """A trained model: ``weight`` of each bucket, ``bias``."""

    weight: np.ndarray
    bias: float
    low: int
    high: int

    def word(self, word: str) -> tuple[float, float]:
        ids = gram_ids(word, self.low, self.high, len(self.weight))
        return float(self.weight[ids].sum()), float(len(ids))

    def scores(self, table: RowTable, texts: list[str | None]) -> np.ndarray:
        total, n = table.sums([words_of(t) for t in texts]).T
        return 1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(n, 1.0) + self.bias, -60, 60)))


def fit(texts: list[str | None], labels: list[int], prior: float, *, dim: int = 8, low: int = 3, high: int = 5, buckets: int = 1 << 18, epochs: int = 12, rate: float = 0.1, batch: int = 96, scale: float = 20.0, least: int = 3, decay: float = 1e-4, seed: int = 7) -> Toxicity:
    """Train vectors and softmax jointly; ``prior`` is the share of label 1 among all labelled rows.

    The sample may hold another share than ``prior``; the bias is corrected for that.
    """
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        p = min(max(float(prior), 1e-6), 1 - 1e-6)
        return Toxicity(np.zeros(buckets, np.float32), float(np.log(p / (1 - p))), low, high)
    rng = np.random.default_rng(seed)
    bags = Bags(texts, low, high, buckets, least)
    vec = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = rng.normal(0, 1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = np.full((buckets, 1), 1e-6, np.float32)
    squares_out, squares_bias = np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    balance = len(y) / (2.0 * np.bincount(y, minlength=2))
    for _ in range(epochs):
        for rows, cols, x in bags.batches(batch, rng):
            x *= scale
            hidden = x @ vec[cols]
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (balance[y[rows]] / len(rows))[:, None].astype(np.float32)
            to_vec, to_out, to_bias = x.T @ (p @ out.T), hidden.T @ p, p.sum(0)
            to_vec += decay * vec[cols]
            squares[cols] += (to_vec**2).mean(1, keepdims=True)
            vec[cols] -= rate * to_vec / np.sqrt(squares[cols])
            squares_out += to_out**2
            out -= 0.1 * to_out / np.sqrt(squares_out)
            squares_bias += to_bias**2
            bias -= 0.1 * to_bias / np.sqrt(squares_bias)
    p = min(max(float(prior), 1e-6), 1 - 1e-6)
    vec[~bags.known] = 0
    return Toxicity((vec @ (out[:, 1] - out[:, 0]) * scale).astype(np.float32), float(bias[1] - bias[0] + np.log(p / (1 - p))), low, high)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 2500, seed: int = 7) -> Toxicity:
    """Fit on about ``per_label`` rows of each label outside the held-out remainder.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out. The bound on the sample is ``per_label``, in the
    mean; a hash of the id picks the rows, so every part of the corpus is drawn from alike.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & (crc_mod(F.col(id_col), 4) != 2))
        .groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    )
    count = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(count.values())
    share = F.when(F.col("y") == 1, F.lit(min(1.0, per_label / max(1, count.get(1, 0))))).otherwise(min(1.0, per_label / max(1, count.get(0, 0))))
    chosen = known.where(hash_share(F.col("id"), seed) < share)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").collect()
    return fit([r.text for r in rows], [r.y for r in rows], count.get(1, 0) / max(1, total), seed=seed)


def score_column(spark: SparkSession, model: Toxicity, text: Column, words: int = 400_000) -> Column:
    """The score of a text column, as a column of the same rows; a task keeps the sums of about ``words`` words at most."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        seen = RowTable(own.word, 2, words)
        for texts in batches:
            held = texts.tolist()
            parts = [own.scores(seen, held[i : i + 512]) for i in range(0, len(held), 512)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return run(text.cast("string"))


def score(docs: DataFrame, model: Toxicity, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), score_column(docs.sparkSession, model, F.col(text_col)).alias("score"))
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = 0.3, words: int = 400_000, **how) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, all columns as they are."""
    model = train(docs, labels, text_col=text_col, **how)
    return docs.where(score_column(docs.sparkSession, model, F.col(text_col), words) < threshold)


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Train on the labelled rows of ``docs`` and score all of it."""
    return score(docs, train(docs, labels, **how))
