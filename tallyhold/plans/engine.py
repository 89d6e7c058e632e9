"""Passes over file trees: walk, difference, log, fold, backup, publish; and what reads the result.

The log is written first and everything else is derived from it, so a run that ends anywhere is taken up by the next.
"""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.errors import ChainError, ConfigError, IntegrityError, NotFoundError, UnsupportedVersionError
from tallyhold.functions.clock import HybridClock
from tallyhold.functions.crypto import ChunkTransform, Identity, load_or_create_key, public_key
from tallyhold.operators import chain, chunking, inventory, projection, scan
from tallyhold.schemas import CATALOG, LOG, SYNCED
from tallyhold.sources import files
from tallyhold.sources.config import Config
from tallyhold.sources.shuffles import freed
from tallyhold.sources.store import Store


@dataclass(frozen=True)
class PassSummary:
    files_seen: int = 0
    bytes_seen: int = 0
    observed: int = 0
    vanished: int = 0
    unreadable: int = 0
    backed_up: int = 0
    chunks_total: int = 0
    chunks_uploaded: int = 0
    bytes_uploaded: int = 0


class Engine:
    """One machine's part in a store that many share."""

    def __init__(self, spark: SparkSession, config: Config, *, transform: ChunkTransform | None = None, key: bytes | None = None):
        if key is None and not config.key_file:
            raise ConfigError("machine.key_file is missing")
        self.spark, self.config, self.transform = spark, config, transform or Identity()
        self.key = key or load_or_create_key(config.key_file)
        self.machine = public_key(self.key).hex()
        self.store = Store(spark, config.store, config.store_options | config.secrets())
        own = self.store.log().where(F.col("machine") == self.machine).agg(F.max("hlc")).first()[0]
        self.clock = HybridClock(own or 0)

    # state

    def log(self) -> DataFrame:
        return self.store.log()

    def projection(self) -> projection.Projection:
        """The fold of all events: of the latest snapshot there is, and of the events that it doesn't have yet."""
        log = self.log()
        last = projection.last_snapshot(log).first()
        if last is None or not self.store.exists(f"snapshots/{last.state_hash}/CURRENT"):
            return projection.fold(log)
        base = self.store.snapshot(last.state_hash)
        have = base.tips.select("machine", F.col("seq").alias("_have"))
        rest = log.join(have, "machine", "left").where(F.col("_have").isNull() | (F.col("seq") > F.col("_have"))).drop("_have")
        return projection.fold(rest, base)

    def catalog(self) -> DataFrame:
        found = self.store.current(f"catalog-{self.machine}", "catalog")
        return self.spark.createDataFrame([], CATALOG) if found is None else found

    def append(self, events: DataFrame) -> int:
        """Number, date, link, sign and push events of this machine."""
        tip = projection.chain_tips(self.log().where(F.col("machine") == self.machine)).first()
        empty = self.spark.createDataFrame([], LOG)
        rows = empty.drop("hlc", "seq", "prev", "hash", "sig").unionByName(events.withColumn("machine", F.lit(self.machine)), allowMissingColumns=True)
        # a clock value for each event: consecutive ones from the next tick on
        rows = rows.withColumn("hlc", F.lit(0).cast("long")).withColumn("_order", F.when(F.col("action") == "pass_completed", 1).otherwise(0))
        w = chain.W.partitionBy("machine").orderBy("_order", "action", "path", "content")
        start = self.clock.tick()
        rows = rows.withColumn("_n", F.row_number().over(w).cast("long")).withColumns({"hlc": F.col("_n") + F.lit(start - 1), "seq": F.col("_n") + F.lit(tip.seq if tip else -1)}).drop("_n", "_order")
        before = self.spark.createDataFrame([(self.machine, tip.hash)] if tip else [], "machine string, hash string")
        # links are serial, signatures aren't: they are made by all tasks, of the hashes as written down
        links = self.store.stage("links", chain.linked(rows, before))
        n = self.store.push(chain.signed(links, {self.machine: self.key}).select(*empty.columns), self.machine)
        self._forget(links)
        self.clock.witness(start + n)
        return n

    def _forget(self, *staged: DataFrame) -> None:
        for df in staged:
            self.store.unstage(df)

    # passes

    def run_pass(self, *, backup: bool = True) -> PassSummary:
        """Scan all roots, log what changed, and back up all that isn't (unless told otherwise)."""
        with freed(self.spark):
            total = self._scan()
        return self._with_backup(total) if backup else total

    def _scan(self) -> PassSummary:
        total = PassSummary()
        for root in self.config.roots:
            catalog = self.catalog()
            # files may change at any time: what was seen is written down, and log and catalog come from that
            staged: list[DataFrame] = []

            def seen(name: str, df: DataFrame, staged: list[DataFrame] = staged) -> DataFrame:
                staged.append(self.store.stage(name, df))
                return staged[-1]

            walked = seen("walk", files.walk(self.spark, root, excludes="\n".join(self.config.excludes), **self.config.scan_options))
            found = seen("found", scan.classify(walked, inventory.under_root(catalog, root)))
            got = seen("hashes", files.hashed(scan.to_hash(found).select("path", "size", "mtime", "file_id")))
            events = seen("events", scan.events(found, got, root))
            n = {r.action: r["count"] for r in events.groupBy("action").count().collect()}
            done = events.where("action = 'pass_completed'").first()
            bad = found.where("status = 'unreadable'").count() + got.where("error is not null").count()
            self.append(events)
            self.store.replace(f"catalog-{self.machine}", {"catalog": scan.next_catalog(catalog, found, got, root, self.clock.current)})
            self._forget(*staged)
            total = PassSummary(total.files_seen + done.files_seen, total.bytes_seen + done.bytes_seen, total.observed + n.get("observed", 0), total.vanished + n.get("vanished", 0), total.unreadable + bad)
        return total

    def run_pass_metadata_only(self) -> PassSummary:
        return self.run_pass(backup=False)

    def backup_pending(self) -> PassSummary:
        """Back up every content that lives here and isn't backed up, whichever pass saw it."""
        return self._with_backup(PassSummary())

    def _with_backup(self, summary: PassSummary) -> PassSummary:
        found = self.projection()
        work = inventory.backup_worklist(found.facts, found.locations, self.machine)
        data = files.loaded(work).persist()
        try:
            with freed(self.spark):
                return self._stored(data, summary)
        finally:
            data.unpersist()

    def _stored(self, data: DataFrame, summary: PassSummary) -> PassSummary:
        if data.isEmpty():
            return summary
        found = chunking.stored(chunking.chunks(data, self.config.average_chunk), self.transform).persist()
        counts = chunking.accounting(found, self.store.chunk_ids()).first()
        self.store.put_chunks(found)
        rows = chunking.refs(found, self.clock.tick())
        # a content without bytes has no chunk; one row stands for its manifest
        none = data.where(F.octet_length("data") == 0).select("content")
        self.store.put_manifests(rows.unionByName(none.select("content", F.lit(None).cast("int").alias("ordinal"), F.lit(0).cast("long").alias("total_size"), F.lit(1).alias("version"), F.lit(self.clock.current).cast("long").alias("created_at")), allowMissingColumns=True))
        n = data.count()
        self.append(data.select(F.lit("backed").alias("action"), "content"))
        found.unpersist()
        return PassSummary(summary.files_seen, summary.bytes_seen, summary.observed, summary.vanished, summary.unreadable, n, counts.chunks_total, counts.chunks_uploaded, counts.bytes_uploaded)

    def restore(self, content: str, out: str) -> None:
        """Write the content to a file, once all of it has been verified.

        Chunks are verified and decrypted by the tasks, and come to the file one part after the other; it gets its name last.
        """
        rows = self.store.manifest(content).where("ordinal is not null")
        got = self.store.stage("restored", chunking.parts(rows, self.store.chunks(), self.transform).repartitionByRange("ordinal").sortWithinPartitions("ordinal"))
        beside = f"{out}.{uuid.uuid4().hex}.part"
        try:
            bad = got.where("fault is not null").orderBy("ordinal").select("fault").first()
            if bad and bad.fault == "version":
                raise UnsupportedVersionError(f"the manifest of {content}")
            if bad and bad.fault == "missing":
                raise NotFoundError(f"a chunk of {content}")
            if bad:
                raise IntegrityError(f"{content}: {bad.fault}")
            whole = hashlib.sha256()
            with open(beside, "wb") as f:
                for r in got.select("ordinal", "plain").orderBy("ordinal").select("plain").toLocalIterator():
                    whole.update(r.plain)
                    f.write(r.plain)
            if whole.hexdigest() != content:
                raise IntegrityError(f"{content}: hash")
            os.replace(beside, out)
        finally:
            self.store.unstage(got)
            if os.path.exists(beside):
                os.unlink(beside)

    # others' logs, and checks

    def synced(self) -> DataFrame:
        """machine, last_seq, hash: how far this machine has taken the logs of others."""
        found = self.store.current(f"synced-{self.machine}", "synced")
        return self.spark.createDataFrame([], SYNCED) if found is None else found

    def pull(self, synced: DataFrame | None = None) -> DataFrame:
        """Events of other machines since the last pull (or after ``synced``: machine, last_seq, hash), verified against the
        headers they were pushed with; an error names the first fault. How far it came is kept in the store."""
        synced = self.synced() if synced is None else synced
        segments = inventory.new_segments(self.store.segments().where(F.col("machine") != self.machine), synced)
        rows = self.store.stage("pulled", self.log().join(segments.select("machine", "seq_start"), ["machine", "seq_start"], "left_semi"))
        fault = self._verified(rows, segments, synced).where("error is not null").orderBy("owner", "seq_start").first()
        if fault:
            raise ChainError(fault.error, fault.owner, fault.error_seq)
        last = rows.agg(F.max("hlc")).first()[0]
        if last:
            self.clock.witness(last)
            tips = projection.chain_tips(rows).select("machine", F.col("seq").alias("last_seq"), "hash")
            both = synced.select("machine", "last_seq", "hash").unionByName(tips).groupBy("machine").agg(F.max("last_seq").alias("last_seq"), F.max_by("hash", "last_seq").alias("hash"))
            self.store.replace(f"synced-{self.machine}", {"synced": both})
        return rows

    def _verified(self, rows: DataFrame, segments: DataFrame, synced: DataFrame | None = None) -> DataFrame:
        """The first fault of each segment; each goes on from the tip of the one before it, the first from what is synced."""
        name = F.concat_ws("/", "machine", F.lpad(F.col("seq_start").cast("string"), 20, "0")).alias("segment")
        heads = segments.select(name, F.col("machine").alias("owner"), "seq_start", "seq_end", "tip_hash")
        heads = heads.withColumn("known", F.lag("tip_hash").over(chain.W.partitionBy("owner").orderBy("seq_start")))
        if synced is not None:
            heads = heads.join(synced.select(F.col("machine").alias("owner"), F.col("hash").alias("_tip")), "owner", "left").withColumn("known", F.coalesce("known", "_tip")).drop("_tip")
        return chain.verify(rows.select("*", name, F.col("seq").alias("ord")).drop("seq_start"), heads, signatures=True)

    def check(self, *, all_machines: bool = False) -> DataFrame:
        """owner, verified, first_error of this machine's log (or of all), against the headers that it was pushed with."""
        own = F.lit(True) if all_machines else F.col("machine") == self.machine
        segments = self.store.segments().where(own)
        counts = segments.select(F.concat_ws("/", "machine", F.lpad(F.col("seq_start").cast("string"), 20, "0")).alias("segment"), "n")
        return chain.check_own(self._verified(self.log().where(own), segments), counts)

    def status(self) -> DataFrame:
        return inventory.totals(self.projection().counts)

    def candidates(self, retain_seconds: int | None = None, now: int | None = None) -> DataFrame:
        keep = self.config.retain_seconds if retain_seconds is None else retain_seconds
        if keep is None:
            raise ConfigError("no retention is set")
        found = self.projection()
        last = self.log().agg(F.max("hlc")).first()[0] or 0
        return inventory.retention(found.counts, found.locations, max(last, time.time_ns()) if now is None else now, keep)

    def collect_garbage(self, candidates: DataFrame) -> DataFrame:
        """Take back the manifests of the candidates, and return these; chunks and scanned files stay."""
        self.store.delete_manifests(candidates.select("content"))
        return candidates

    def snapshot(self) -> str:
        """Write the projection as a snapshot, and log that."""
        value = self.store.put_snapshot(self.projection())
        self.append(self.spark.createDataFrame([("snapshot", value)], "action string, state_hash string"))
        return value
