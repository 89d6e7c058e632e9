"""Machines' logs as hash chains: numbering, linking, segments and their verification.

Only writing a chain is serial, and only within a machine: it streams over sorted rows with the last hash in hand. Checking
compares each row with its neighbour, so it is a window over the machine's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyhold.errors import ChainError, SegmentOwnerError
from tallyhold.functions.crypto import sign, signature_ok
from tallyhold.functions.hashing import body_hash, link_hash
from tallyhold.schemas import ZERO_HASH

#: Kinds of errors of a segment, the first of which counts: those of its header, of its place, of its entries.
PRECEDENCE = ("empty_segment", "first_not_start", "last_not_end", "tip_mismatch", "not_genesis", "unknown_start", "restarted", "broken_from_tip", "machine_mismatch", "non_contiguous", "broken_chain", "invalid_hash", "invalid_signature")


def number(events: DataFrame, *, first: int = 0) -> DataFrame:
    """Column seq: first, first + 1, ... for each machine in the order of its clock."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy("machine").orderBy("hlc")).cast("long") + F.lit(first - 1))


def linked(events: DataFrame, tips: DataFrame | None = None, keys: dict[str, bytes] | None = None) -> DataFrame:
    """Columns prev, hash and sig (null but for machines whose secret is given) of numbered events.

    ``tips`` (machine, hash) are the hashes that the events follow; without one a chain begins at zeros. Only the links are
    made in one task for each machine; signatures are made by all.
    """
    rows = events.drop("prev", "hash", "sig").withColumn("_body", body_hash())
    rows = rows.join(tips.select("machine", F.col("hash").alias("_tip")), "machine", "left") if tips is not None else rows.withColumn("_tip", F.lit(None).cast("string"))
    rows = rows.withColumn("_tip", F.coalesce("_tip", F.lit(ZERO_HASH)))
    at = [rows.columns.index(c) for c in ("machine", "_body", "_tip")]
    keep = [i for i, c in enumerate(rows.columns) if c not in ("_body", "_tip")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, last = object(), ""
        for b in batches:
            prev, own = [], []
            for m, body, tip in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                if m != machine:
                    machine, last = m, tip
                prev.append(last)
                last = hashlib.sha256((last + body).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(prev, pa.string()), pa.array(own, pa.string())], names=[*(b.schema.names[i] for i in keep), "prev", "hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_body", "_tip"))
    found = rows.repartition("machine").sortWithinPartitions("machine", "seq").mapInArrow(run, f"{schema}, prev string, hash string")
    return signed(found, keys) if keys else found.withColumn("sig", F.lit(None).cast("string"))


def signed(entries: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """Linked entries with the signature (sig, hex) of their hash by their machine's secret, null for other machines."""

    @F.pandas_udf("string")
    def of(machines: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([sign(keys[m], bytes.fromhex(h)).hex() if m in keys else None for m, h in zip(machines, hashes, strict=True)], dtype=object)

    return entries.drop("sig").repartition("machine", "seq").withColumn("sig", of("machine", "hash"))


def gaps(events: DataFrame) -> DataFrame:
    """machine, seq, previous_seq of the events that don't follow the one before them."""
    w = W.partitionBy("machine").orderBy("seq")
    return events.withColumn("previous_seq", F.lag("seq").over(w)).where(F.col("seq") - F.col("previous_seq") != 1).select("machine", "seq", "previous_seq")


def clock_faults(events: DataFrame) -> DataFrame:
    """machine, seq, hlc, previous_hlc of the events whose clock isn't after that of the one before."""
    w = W.partitionBy("machine").orderBy("seq")
    return events.withColumn("previous_hlc", F.lag("hlc").over(w)).where(F.col("hlc") <= F.col("previous_hlc")).select("machine", "seq", "hlc", "previous_hlc")


def segment_headers(entries: DataFrame, *by: str) -> DataFrame:
    """machine, seq_start, seq_end, tip_hash and n of the entries of each segment (of each machine, without ``by``)."""
    keys = by or ("machine",)
    found = entries.groupBy(*keys).agg(F.min("machine").alias("_machine"), F.count_distinct("machine").alias("machines"), F.min("seq").alias("seq_start"), F.max("seq").alias("seq_end"), F.max_by("hash", "seq").alias("tip_hash"), F.count("*").alias("n"))
    found = found.withColumn("contiguous", (F.col("machines") == 1) & (F.col("n") == F.col("seq_end") - F.col("seq_start") + 1))
    return found.drop("_machine") if "machine" in keys else found.withColumnRenamed("_machine", "machine")


def one_segment(entries: DataFrame, machine: str | None = None) -> DataFrame:
    """The entries, if they can be one segment: some, of one machine (the one given), without a gap; else an error."""
    head = entries.groupBy().agg(F.count("*").alias("n"), F.min("machine").alias("low"), F.max("machine").alias("high"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_distinct("seq").alias("kinds")).first()
    if not head.n:
        raise ChainError("empty_segment")
    if head.low != head.high:
        raise ChainError("machine_mismatch", head.high)
    if head.kinds != head.n or head["last"] - head["first"] + 1 != head.n:
        raise ChainError("non_contiguous", head.low)
    if machine is not None and head.low != machine:
        raise SegmentOwnerError(f"{head.low} isn't {machine}")
    return entries


def verify(entries: DataFrame, headers: DataFrame, tips: DataFrame | None = None, *, signatures: bool = False) -> DataFrame:
    """The first fault of each segment: segment, owner, seq_start, error (null: none), error_seq.

    ``entries`` have ``segment`` and ``ord`` (the place in it) beside the columns of a log, ``headers`` segment, owner,
    seq_start, seq_end and tip_hash as claimed. The known hash before a segment is the header's ``known``, if there is such a
    column, else its machine's in ``tips`` (machine, hash).
    """
    w = W.partitionBy("segment").orderBy("ord")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = headers.join(entries, "segment", "left")
    if "known" not in headers.columns:
        rows = rows.join(tips.select(F.col("machine").alias("owner"), F.col("hash").alias("known")), "owner", "left") if tips is not None else rows.withColumn("known", F.lit(None).cast("string"))
    rows = rows.withColumns({"first_seq": F.first("seq").over(whole), "last_seq": F.last("seq").over(whole), "last_hash": F.last("hash").over(whole), "first_prev": F.first("prev").over(whole), "before_seq": F.lag("seq").over(w), "before_hash": F.lag("hash").over(w)})
    first = F.col("before_seq").isNull()
    tests: dict[str, Column] = {
        "empty_segment": F.col("ord").isNull(),
        "first_not_start": F.col("first_seq") != F.col("seq_start"),
        "last_not_end": F.col("last_seq") != F.col("seq_end"),
        "tip_mismatch": ~F.col("last_hash").eqNullSafe(F.col("tip_hash")),
        "not_genesis": F.col("known").isNull() & (F.col("seq_start") == 0) & (F.col("first_prev") != ZERO_HASH),
        "unknown_start": F.col("known").isNull() & (F.col("seq_start") > 0),
        "restarted": F.col("known").isNotNull() & (F.col("seq_start") == 0),
        "broken_from_tip": F.col("known").isNotNull() & (F.col("first_prev") != F.col("known")),
        "machine_mismatch": F.col("machine") != F.col("owner"),
        "non_contiguous": ~first & (F.col("seq") != F.col("before_seq") + 1),
        "broken_chain": ~first & (F.col("prev") != F.col("before_hash")),
        "invalid_hash": ~F.col("hash").eqNullSafe(link_hash(F.col("prev"), body_hash())),
        "invalid_signature": ~signature_ok("machine", "hash", "sig") if signatures else F.lit(False),
    }
    of_segment = 8
    code = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(PRECEDENCE))):
        code = F.when(F.coalesce(tests[name], F.lit(False)), k).otherwise(code)
    rows = rows.withColumn("code", code)
    # faults of the segment come before those of any entry; then the first entry counts, and of it the first test
    rank = F.when(F.col("code").isNotNull(), F.struct(F.when(F.col("code") < of_segment, -1).otherwise(F.col("ord")).alias("at"), "code", "seq"))
    found = rows.groupBy("segment", "owner", "seq_start").agg(F.min(rank).alias("fault"))
    names = F.array(*map(F.lit, PRECEDENCE))
    return found.select("segment", "owner", "seq_start", F.when(F.col("fault").isNotNull(), F.get(names, F.col("fault.code"))).alias("error"), F.when(F.col("fault.code") >= of_segment, F.col("fault.seq")).alias("error_seq"))


def check_own(results: DataFrame, counts: DataFrame) -> DataFrame:
    """owner, verified entries before the first faulty segment, first_error: what a check of one's own log reports."""
    w = W.partitionBy("owner").orderBy("seq_start").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = results.join(counts.select("segment", "n"), "segment", "left").withColumn("bad", F.max(F.col("error").isNotNull().cast("int")).over(w))
    return rows.groupBy("owner").agg(F.coalesce(F.sum(F.when(F.col("bad") == 0, F.col("n"))), F.lit(0).cast("long")).alias("verified"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq_start"))).alias("first_error"))
