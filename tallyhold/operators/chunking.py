"""Content-defined chunks, manifests, backup and restore as table operations.

Cuts follow FastCDC (Xia et al., USENIX ATC 2016): a rolling gear hash, two masks around the target size, and a least and a
most size, 1 : 4 : 16. The hash's window is the last 64 bytes, whatever the cuts, so it is computed for all positions of a
content at once, by doubling, and only the positions where a mask matches are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyhold.errors import ConfigError
from tallyhold.functions.crypto import ChunkTransform, Identity
from tallyhold.functions.hashing import content_hash

DEFAULT_AVERAGE = 1 << 20
LEAST_AVERAGE = 256
#: A random number for each byte value, made from its hash.
GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear %d" % b).digest()[:8], "little") for b in range(256)], np.uint64)


def _gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gear values of the last 64 bytes, each shifted by its distance."""
    h, step = GEAR[data], 1
    while step < 64:
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint64(step)
        h, step = h + shifted, step * 2
    return h


def _mask(bits: int) -> np.uint64:
    """``bits`` high bits, two apart at first: far bytes matter as well as near ones."""
    return np.uint64(sum(1 << (63 - 2 * k if k < 24 else 62 - 2 * (k - 24)) for k in range(bits)))


def cuts(data: bytes, average: int = DEFAULT_AVERAGE, before: bytes = b"") -> list[int]:
    """End of each chunk; none for no bytes. ``before`` are the bytes that precede the data, up to 63 of them."""
    if average < LEAST_AVERAGE:
        raise ConfigError(f"the average chunk size is at least {LEAST_AVERAGE}")
    least, most, n = average // 4, average * 4, len(data)
    if not n:
        return []
    h, bits = _gear_hashes(np.frombuffer(before + data, np.uint8))[len(before) :], average.bit_length() - 1
    hard, easy = (np.flatnonzero((h & _mask(b)) == 0) + 1 for b in (bits + 1, bits - 1))
    ends, start = [], 0
    while start < n:
        if n - start <= least:
            ends.append(n)
            break
        end, middle = min(n, start + most), start + average
        k = np.searchsorted(hard, start + least)
        if k < len(hard) and hard[k] < min(middle, end):
            end = int(hard[k])
        else:
            k = np.searchsorted(easy, middle)
            if k < len(easy) and easy[k] < end:
                end = int(easy[k])
        ends.append(end)
        start = end
    return ends


def streamed(blocks: Iterable[bytes], average: int = DEFAULT_AVERAGE) -> Iterator[bytes]:
    """The chunks of a content that comes in blocks, cut where ``cuts`` cuts the whole of it; memory holds a few of the largest."""
    most, back, held = average * 4, b"", bytearray()

    def ready(last: bool) -> Iterator[bytes]:
        """Chunks whose end nothing that follows can move; the bytes before them are part of the hash's window."""
        nonlocal back
        start = 0
        for end in cuts(bytes(held), average, back):
            if end - start < most and not last and len(held) - start < most:
                break
            yield bytes(held[start:end])
            start = end
        back = (back + bytes(held[max(0, start - 63) : start]))[-63:]
        del held[:start]

    for block in blocks:
        held += block
        if len(held) >= 4 * most:
            yield from ready(False)
    yield from ready(True)


def chunks(contents: DataFrame, average: int = DEFAULT_AVERAGE) -> DataFrame:
    """content, total_size, ordinal, offset, data of each chunk of (content, data); empty contents give none."""
    if average < LEAST_AVERAGE:
        raise ConfigError(f"the average chunk size is at least {LEAST_AVERAGE}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ends = cuts(data or b"", average)
                if ends:
                    starts = [0, *ends[:-1]]
                    n = len(ends)
                    yield pa.RecordBatch.from_arrays([pa.array([content] * n, pa.string()), pa.array([len(data)] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(starts, pa.int64()), pa.array([data[s:e] for s, e in zip(starts, ends, strict=True)], pa.binary())], names=["content", "total_size", "ordinal", "offset", "data"])

    return contents.select("content", F.col("data").cast("binary")).mapInArrow(run, "content string, total_size long, ordinal int, offset long, data binary")


def stored(found: DataFrame, transform: ChunkTransform | None = None) -> DataFrame:
    """The chunks as stored: content, total_size, ordinal, offset, chunk_id, size (stored), data."""
    rows = found.withColumn("data", (transform or Identity()).apply(F.col("data")))
    return rows.select("content", "total_size", "ordinal", "offset", content_hash(F.col("data")).alias("chunk_id"), F.octet_length("data").cast("long").alias("size"), "data")


def refs(found: DataFrame, created_at: int) -> DataFrame:
    """Manifests in rows, one a chunk: content, ordinal, chunk_id, offset, size, total_size, version, created_at."""
    return found.select("content", "ordinal", "chunk_id", "offset", "size", "total_size", F.lit(1).alias("version"), F.lit(created_at).cast("long").alias("created_at"))


def manifests(rows: DataFrame) -> DataFrame:
    """version, content, total_size, chunks (array of id, offset, size in order), created_at of each content."""
    chunk = F.struct(F.col("chunk_id").alias("id"), "offset", "size")
    return rows.groupBy("content").agg(F.max("version").alias("version"), F.max("total_size").alias("total_size"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", chunk.alias("c")))), lambda x: x["c"]).alias("chunks"), F.max("created_at").alias("created_at"))


def absent(found: DataFrame, existing: DataFrame, key: str = "chunk_id") -> DataFrame:
    """What isn't stored yet, once each."""
    return found.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def accounting(found: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: chunks_total, bytes_total, chunks_uploaded, bytes_uploaded."""
    new = absent(found, existing).agg(F.count("*").alias("chunks_uploaded"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_uploaded"))
    return found.agg(F.count("*").alias("chunks_total"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_total")).crossJoin(new)


def plain_lengths(rows: DataFrame) -> DataFrame:
    """Manifest rows with ``length``: the plain bytes of each chunk, up to the next offset or the content's end."""
    w = W.partitionBy("content").orderBy("offset", "ordinal")
    return rows.withColumn("length", F.coalesce(F.lead("offset").over(w), F.col("total_size")) - F.col("offset"))


def coverage(rows: DataFrame) -> DataFrame:
    """content, covered: whether its chunks' plain lengths follow each other from 0 to its size."""
    w = W.partitionBy("content").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    at = rows.withColumn("_before", F.coalesce(F.sum("length").over(w), F.lit(0)))
    return at.groupBy("content").agg((F.min(F.col("_before") == F.col("offset")) & (F.sum("length") == F.max("total_size"))).alias("covered"))


def parts(rows: DataFrame, chunk_store: DataFrame, transform: ChunkTransform | None = None) -> DataFrame:
    """content, ordinal, plain, fault of each chunk of a manifest: fault (null: none) is what failed first of version, missing,
    corrupt, undecipherable, length."""
    got = plain_lengths(rows).join(chunk_store.select("chunk_id", "data"), "chunk_id", "left")
    got = got.withColumn("plain", (transform or Identity()).reverse(F.col("data")))
    fault = (
        F.when(F.col("version") != 1, "version").when(F.col("data").isNull(), "missing").when(content_hash(F.col("data")) != F.col("chunk_id"), "corrupt").when(F.col("plain").isNull(), "undecipherable").when(F.octet_length("plain") != F.col("length"), "length")
    )
    return got.select("content", "ordinal", "plain", fault.alias("fault"))


def restored(rows: DataFrame, chunk_store: DataFrame, transform: ChunkTransform | None = None) -> DataFrame:
    """content, data, error of each content: error says what failed first (version, missing, corrupt, undecipherable, length, hash).

    Nothing of a content that doesn't verify is given: its data is null.
    """
    got = parts(rows, chunk_store, transform)
    held = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "plain"))), lambda x: x["plain"])
    whole = got.groupBy("content").agg(held.alias("parts"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("ordinal"))).alias("error"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x)), ""))
    whole = whole.withColumn("data", F.when(F.col("error").isNull(), joined))
    wrong = F.col("error").isNull() & ~content_hash(F.col("data")).eqNullSafe(F.col("content"))
    whole = whole.withColumn("error", F.when(wrong, "hash").otherwise(F.col("error")))
    return whole.select("content", F.when(F.col("error").isNull(), F.col("data")).alias("data"), "error")
