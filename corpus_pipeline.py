"""Corpus pipeline: stages, each one operator of ``tallyhold.llm``, each working on all that the one before it kept.

Each stage takes (spark, docs, sf_dir), docs being the table that the stage before it wrote, and returns a table of the same
columns, the last one the packed pieces.

Edge cases. Null and empty texts are neither toxic nor near copies, have nothing to repeat and no window, and stay until the
packing, where they are the end id alone. Very long texts are read whole by every stage. Of repeated rows, which are near copies
of each other, one stays: that of the least doc_id (null last), of equal doc_ids the first; texts without words stay all. Ties:
a score that equals the threshold is toxic, a similarity that equals 0.75 a link. An empty table gives an empty table of the same
columns. Further columns, whatever their names, go through the first four stages as they are, but for ``n_chars``, which is
counted anew where a text was cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhold.llm import decontaminate, packing, repeats, setjoin, toxicity
from tallyhold.llm.common import dropped, prepared, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labelled part, doesn't reject."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"), words=150_000)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of word-shingle similarity of 0.75 or more make."""
    prepared(spark)
    return setjoin.first_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 200 bytes or more that the corpus repeats."""
    prepared(spark)
    return repeats.clean(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    prepared(spark)
    return packing.digest(packing.pack(docs, room=48_000_000, keep=0))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the trained, hashing and packing stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again for the next, and deleted once that is written."""
    docs, before = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        dropped(*before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
