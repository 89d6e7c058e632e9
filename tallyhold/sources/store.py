"""The shared store: chunks, manifests, logs and snapshots under one URI of any file system that Spark reaches.

Objects are rows of Parquet tables, ``chunks``, ``manifests``, ``log`` (partitioned by machine) and ``snapshots/<hash>``. Writes
of objects are put-if-absent by their keys, so doing one again changes nothing. Nothing is ever taken out of a table: what is
deleted is named by rows of a table beside it. What is replaced (the projection of a pass) is written beside and then
named by a pointer file, which is the commit. A row of the log carries its segment's header, written before anyone
reads it, so a segment that has lost or changed rows doesn't fit its own header any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.errors import IntegrityError, NotFoundError, SegmentOwnerError
from tallyhold.functions.hashing import content_hash
from tallyhold.operators.chunking import absent
from tallyhold.operators.projection import Projection, state_hash
from tallyhold.schemas import CHUNK_REFS, CHUNKS, LOG, SEGMENT


class Store:
    def __init__(self, spark: SparkSession, uri: str, options: dict[str, str] | None = None):
        self.spark, self.uri = spark, uri.rstrip("/")
        self._staged: list[tuple[DataFrame, str]] = []
        for key, value in (options or {}).items():
            spark.sparkContext._jsc.hadoopConfiguration().set(key, value)

    # files

    def _path(self, key: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{key}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, key: str) -> bool:
        fs, path = self._path(key)
        return fs.exists(path)

    def names(self, key: str) -> list[str]:
        """What lies in a folder; nothing if there is none."""
        fs, path = self._path(key)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _read(self, key: str, schema: str) -> DataFrame:
        if not self.exists(key):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.uri}/{key}")

    def _versions(self, name: str) -> list[str]:
        """The current version, and the one before it; none if there is no pointer."""
        if not self.exists(f"{name}/CURRENT"):
            return []
        return self.spark.read.text(f"{self.uri}/{name}/CURRENT", wholetext=True).first().value.split()

    def _commit(self, name: str, versions: list[str]) -> None:
        """Name the first version as the current one: written beside, then moved over in one step."""
        fs, path = self._path(f"{name}/CURRENT")
        beside = self._path(f"{name}/.CURRENT-{uuid.uuid4().hex}")[1]
        out = fs.create(beside, True)
        out.write(bytearray("\n".join(versions).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(beside, path, rename)

    def replace(self, name: str, tables: dict[str, DataFrame]) -> None:
        """Write all tables as one new version, which readers see whole or not at all; of the older ones the last stays."""
        version, before = uuid.uuid4().hex, self._versions(name)
        for table, df in tables.items():
            df.write.parquet(f"{self.uri}/{name}/{version}/{table}")
        self._commit(name, [version, *before[:1]])
        # only what this pointer has named: others may be at work on versions of theirs
        for old in before[1:]:
            self.drop(f"{name}/{old}")

    def current(self, name: str, table: str) -> DataFrame | None:
        versions = self._versions(name)
        return self.spark.read.parquet(f"{self.uri}/{name}/{versions[0]}/{table}") if versions else None

    def drop(self, key: str) -> None:
        """Delete what lies there, if anything does."""
        fs, path = self._path(key)
        fs.delete(path, True)

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as written under the name: what is read of it stays the same, whatever becomes of its source."""
        path = f"{self.uri}/staged/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        got = self.spark.read.schema(df.schema).parquet(path)
        self._staged.append((got, path))
        return got

    def unstage(self, df: DataFrame) -> None:
        """Delete what ``stage`` has written for this table."""
        for got, path in self._staged:
            if got is df:
                self.drop(path.removeprefix(f"{self.uri}/"))
        self._staged = [x for x in self._staged if x[0] is not df]

    # chunks and manifests

    def _chunks(self) -> DataFrame:
        """chunk_id, data, put: rows as stored, deleted ones left out."""
        gone = self._read("chunks-deleted", "chunk_id string, put string")
        return self._read("chunks", f"{CHUNKS}, put string").join(gone, ["chunk_id", "put"], "left_anti")

    def chunk_ids(self) -> DataFrame:
        return self._chunks().select("chunk_id")

    def put_chunks(self, chunks: DataFrame) -> None:
        new = absent(chunks.select("chunk_id", "data"), self.chunk_ids())
        new.withColumn("put", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(f"{self.uri}/chunks")

    def chunks(self) -> DataFrame:
        """Chunks as stored, each id once (two writers may both have put one)."""
        return self._chunks().select("chunk_id", "data").dropDuplicates(["chunk_id"])

    def verified(self, ids: DataFrame) -> DataFrame:
        """chunk_id, data of these ids; an error if one has other bytes."""
        rows = self.chunks().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
        return rows.withColumn("data", F.when(content_hash(F.col("data")) == F.col("chunk_id"), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("corrupt chunk "), F.col("chunk_id"))).cast("binary")))

    def has(self, ids: DataFrame) -> DataFrame:
        """Those of the ids that are stored."""
        return ids.join(self.chunk_ids(), "chunk_id", "left_semi")

    def delete_chunk(self, chunk_id: str) -> None:
        rows = self._chunks().where(F.col("chunk_id") == chunk_id).select("chunk_id", "put")
        if rows.isEmpty():
            raise NotFoundError(f"chunk {chunk_id}")
        rows.write.mode("append").parquet(f"{self.uri}/chunks-deleted")

    def manifests(self) -> DataFrame:
        """Manifest rows, those of deleted contents left out."""
        gone = self._read("manifests-deleted", "content string, upto long")
        rows = self._read("manifests", CHUNK_REFS).dropDuplicates(["content", "ordinal"])
        return rows.join(gone.groupBy("content").agg(F.max("upto").alias("upto")), "content", "left").where(F.col("upto").isNull() | (F.col("created_at") > F.col("upto"))).drop("upto")

    def put_manifests(self, rows: DataFrame) -> None:
        new = rows.join(self.manifests().select("content").distinct(), "content", "left_anti")
        new.write.mode("append").parquet(f"{self.uri}/manifests")

    def manifest(self, content: str) -> DataFrame:
        rows = self.manifests().where(F.col("content") == content)
        if rows.isEmpty():
            raise NotFoundError(f"manifest of {content}")
        return rows

    def delete_manifests(self, contents: DataFrame, *, missing_ok: bool = True) -> None:
        """Take back these contents' manifests, as they are now; their chunks stay."""
        there = self.manifests().groupBy("content").agg(F.max("created_at").alias("upto"))
        if not missing_ok and not contents.join(there, "content", "left_anti").isEmpty():
            raise NotFoundError("a manifest to delete")
        there.join(contents.select("content").distinct(), "content", "left_semi").write.mode("append").parquet(f"{self.uri}/manifests-deleted")

    # logs

    def _log(self) -> DataFrame:
        return self._read("log", f"{LOG}, {SEGMENT}")

    def log(self) -> DataFrame:
        """Events of all machines, each once, with the start of their segment (seq_start)."""
        return self._log().drop("seq_end", "tip_hash").dropDuplicates(["machine", "seq", "hash"])

    def machines(self) -> DataFrame:
        return self._log().select("machine").distinct().orderBy("machine")

    def segments(self, machine: str | None = None) -> DataFrame:
        """machine, seq_start, seq_end, tip_hash as pushed, and n, the events there are, in the order of their starts."""
        rows = self._log() if machine is None else self._log().where(F.col("machine") == machine)
        found = rows.groupBy("machine", "seq_start").agg(F.max("seq_end").alias("seq_end"), F.max("tip_hash").alias("tip_hash"), F.count_distinct("seq", "hash").alias("n"))
        return found.orderBy("machine", "seq_start")

    def push(self, entries: DataFrame, machine: str) -> int:
        """Append linked events of one's own log as a segment; returns how many."""
        head = entries.agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.max_by("hash", "seq").alias("tip"), F.min("machine").alias("low"), F.max("machine").alias("high")).first()
        if not head.n:
            return 0
        if (head.low, head.high) != (machine, machine):
            raise SegmentOwnerError(f"a segment of {head.low} can't be pushed as {machine}")
        header = {"seq_start": F.lit(head["first"]).cast("long"), "seq_end": F.lit(head["last"]).cast("long"), "tip_hash": F.lit(head.tip)}
        entries.withColumns(header).write.mode("append").partitionBy("machine").parquet(f"{self.uri}/log")
        return head.n

    # snapshots

    def put_snapshot(self, projection: Projection) -> str:
        """Write the projection under its content index's hash; returns that."""
        value = state_hash(projection).first().state_hash
        if not self.exists(f"snapshots/{value}/CURRENT"):
            self.replace(f"snapshots/{value}", projection.tables())
        return value

    def snapshot(self, value: str) -> Projection:
        tables = {name: self.current(f"snapshots/{value}", name) for name in ("locations", "facts", "passes", "tips")}
        if None in tables.values():
            raise NotFoundError(f"snapshot {value}")
        found = Projection(**tables)
        if state_hash(found).first().state_hash != value:
            raise IntegrityError(f"snapshot {value} has another hash")
        return found
