"""Questions to the projection: duplicates, orphans, history, resolution, work lists, retention, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhold.functions.hashing import age, is_hash, seconds, under


def _live(contents: DataFrame) -> Column:
    """The number of live locations, of an index with locations or with their number."""
    return F.col("live") if "live" in contents.columns else F.size("live_locations")


def is_duplicate(contents: DataFrame) -> Column:
    return _live(contents) > 1


def is_orphan(contents: DataFrame) -> Column:
    return F.col("backed_up") & (_live(contents) == 0)


def duplicates(contents: DataFrame) -> DataFrame:
    return contents.where(is_duplicate(contents))


def orphans(contents: DataFrame) -> DataFrame:
    return contents.where(is_orphan(contents))


def history(locations: DataFrame, content: str | Column) -> DataFrame:
    """All locations whose latest state names the content, live or tombstoned."""
    return locations.where(F.col("content") == content)


def live_locations(contents: DataFrame, content: str | Column) -> DataFrame:
    return contents.where(F.col("content") == content).select("content", F.explode("live_locations").alias("at")).select("content", "at.machine", "at.path")


def resolve(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """target, content: a target of 64 hex digits is a content itself, any other a path to look up (null: not found)."""
    looked = targets.join(paths.select(F.col("path").alias("target"), F.col("content").alias("_found")), "target", "left")
    return looked.select("target", F.when(is_hash(F.col("target")), F.lower("target")).otherwise(F.col("_found")).alias("content"))


def under_root(catalog: DataFrame, root: str) -> DataFrame:
    """Catalog rows of the root itself or below it."""
    return catalog.where(under(F.col("path"), root))


def totals(contents: DataFrame) -> DataFrame:
    """One row: contents, live locations, duplicates, orphans, bytes backed up."""
    return contents.agg(
        F.count("*").alias("contents"),
        F.coalesce(F.sum(_live(contents)), F.lit(0)).alias("locations"),
        F.count_if(is_duplicate(contents)).alias("duplicates"),
        F.count_if(is_orphan(contents)).alias("orphans"),
        F.coalesce(F.sum(F.when(F.col("backed_up"), F.col("size"))), F.lit(0)).alias("backed_bytes"),
    )


def backup_worklist(facts: DataFrame, locations: DataFrame, machine: str | Column) -> DataFrame:
    """content, size, path: what isn't backed up and lives on this machine, with the first of its paths there."""
    here = locations.where((F.col("state") == "live") & (F.col("machine") == machine)).groupBy("content").agg(F.min("path").alias("path"))
    return facts.where(~F.col("backed_up")).select("content", "size").join(here, "content")


def new_segments(segments: DataFrame, synced: DataFrame) -> DataFrame:
    """Segments (machine, seq_start, ...) that begin after what has been taken from their machine (last_seq; no row: nothing)."""
    return segments.join(synced.select("machine", "last_seq"), "machine", "left").where(F.col("last_seq").isNull() | (F.col("seq_start") > F.col("last_seq"))).drop("last_seq")


def unneeded_dropped(segments: DataFrame, tips: DataFrame) -> DataFrame:
    """Segments that a snapshot with these tips doesn't cover whole."""
    return segments.join(tips.select("machine", F.col("seq").alias("_tip")), "machine", "left").where(F.col("_tip").isNull() | (F.col("seq_end") > F.col("_tip"))).drop("_tip")


def retention(contents: DataFrame, locations: DataFrame, now: int | Column, retain_seconds: int) -> DataFrame:
    """content, size, last_vanished, age_ns of orphans whose last tombstone is old enough, oldest first.

    Orphans that no tombstone names (their places hold something else now) are no candidates.
    """
    gone = locations.where("state = 'tombstoned'").groupBy("content").agg(F.max("last_hlc").alias("last_vanished"))
    found = orphans(contents).join(gone, "content").select("content", "size", "last_vanished", age(F.lit(now) if isinstance(now, int) else now, F.col("last_vanished")).alias("age_ns"))
    return found.where(F.col("age_ns") >= seconds(F.lit(retain_seconds).cast("long"))).orderBy(F.desc("age_ns"), "content")


def collected(manifests: DataFrame, candidates: DataFrame) -> DataFrame:
    """The manifests without those of the candidates; chunks aren't touched."""
    return manifests.join(candidates.select("content"), "content", "left_anti")
