"""Helpers that the corpus operators share: staging in the shared folder, split rules, batches."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.sources.shuffles import freed

#: The white space that separates words in the word contracts: tab to carriage return, and space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's ``spark.checkpoint.dir`` names it.

    Only where that is unset, and the session runs in one process (local tests), a temporary folder is made and set: on a
    cluster every executor would write to a folder of its own.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tallyhold-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors.

    Files of the shuffles that it took are deleted with it, not only when the driver collects its garbage.
    """
    path = fresh_path(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.parquet(path, **options)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got.staged_at = path
    return got


def dropped(*tables: DataFrame, below: str = "") -> None:
    """Delete what ``staged`` has written for these tables, or a folder of it, once nothing reads that any more."""
    for df in tables:
        jvm, path = df.sparkSession.sparkContext._jvm, f"{df.staged_at}/{below}"
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def prepared(spark: SparkSession, rows: int = 1000, size: int = 4_000_000) -> SparkSession:
    """The session, with Arrow batches of at most so many rows and about so many bytes: whole texts make the usual ones very large."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(re.sub(r"[bB]$", "", spark.conf.get(key))) <= most:
            spark.conf.set(key, most)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo ``n``; null keys count as the text ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return (F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(docs: DataFrame, uids: DataFrame, at_most: int = 1_000_000) -> DataFrame:
    """``docs`` less the rows of these numbers (column ``uid``, as ``monotonically_increasing_id`` gives them for a table).

    The numbers are broadcast if there are few, else met by a shuffle. ``docs`` must be a table as read, so that its rows
    have the same numbers each time.
    """
    gone = staged(uids.select("uid"), "uids")
    gone = F.broadcast(gone) if gone.count() <= at_most else gone
    return numbered(docs).join(gone, "uid", "left_anti").select("row.*")


def numbered(docs: DataFrame) -> DataFrame:
    """uid and, as one struct, row: whatever the columns of ``docs`` are named, none can clash."""
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row"))


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on, idle, beside stages that need it in the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's generator that gives its memory back when it ends."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class RowTable(dict):
    """Maps a word to the row of ``make(word)`` in ``rows``; rows are computed once for each new word.

    Beyond ``cap`` words the table goes on, at the next batch, with the half of them that came first, the frequent
    ones: its memory is bounded, and every word still gets its exact row.
    """

    def __init__(self, make: Callable[[str], tuple], width: int, cap: int = 400_000):
        super().__init__()
        self._make, self._width, self._cap = make, width, cap
        self._rows, self._used, self._new = np.zeros((1024, width)), 0, []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self._new.append(self._make(word))
        return at

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """For each list of words the sum of their rows."""
        if len(self) > self._cap:
            stay = list(islice(self.items(), self._cap // 2))
            self.clear()
            self.update(stay)
            self._used = len(stay)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter((self[w] for words in texts for w in words), np.int64, int(lengths.sum()))
        if self._new:
            end = self._used + len(self._new)
            if end > len(self._rows):
                grown = np.zeros((max(end, 2 * len(self._rows)), self._width))
                grown[: self._used] = self._rows[: self._used]
                self._rows = grown
            self._rows[self._used : end] = self._new
            self._used, self._new = end, []
        ends = np.cumsum(lengths)
        out = np.zeros((len(texts), self._width))
        full = np.flatnonzero(lengths)
        # blocks of texts keep the gathered rows small whatever a batch holds
        start = 0
        while start < len(full):
            stop = max(start + 1, int(np.searchsorted(ends[full], ends[full[start]] + 2_000_000)))
            part = full[start:stop]
            first = ends[part[0]] - lengths[part[0]]
            out[part] = np.add.reduceat(self._rows[ids[first : ends[part[-1]]]], ends[part] - lengths[part] - first)
            start = stop
        return out


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, and of at most ``size`` bytes unless one row alone is larger."""
    for batch in batches:
        todo = [batch.slice(start, rows) for start in range(0, batch.num_rows, rows)][::-1]
        while todo:
            b = todo.pop()
            if b.num_rows > 1 and b.nbytes > size:
                half = b.num_rows // 2
                todo += [b.slice(half), b.slice(0, half)]
            else:
                yield b
