"""Difference of a walked tree and the catalog of the last pass, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhold.functions.hashing import under


def same_stat(a: str, b: str) -> Column:
    """Equal size and mtime, and equal file ids where both have one (0: none)."""
    ids = (F.col(f"{a}.file_id") == 0) | (F.col(f"{b}.file_id") == 0) | (F.col(f"{a}.file_id") == F.col(f"{b}.file_id"))
    return (F.col(f"{a}.size") == F.col(f"{b}.size")) & (F.col(f"{a}.mtime") == F.col(f"{b}.mtime")) & ids


def classify(walk: DataFrame, catalog: DataFrame) -> DataFrame:
    """path, status (unchanged, new, changed, vanished, unreadable), the walk's stat, and the catalog's content.

    A path that couldn't be read, or lies in a folder that couldn't, is no proof of absence: it stays as catalogued.
    """
    errors = walk.where(F.col("error").isNotNull()).select(F.col("path").alias("_bad"))
    both = walk.alias("w").join(catalog.alias("c"), F.col("w.path") == F.col("c.path"), "full_outer")
    status = (
        F.when(F.col("w.error").isNotNull(), "unreadable").when(F.col("w.path").isNull(), "vanished").when(F.col("c.path").isNull(), "new").when(same_stat("w", "c"), "unchanged").otherwise("changed")
    )
    rows = both.select(F.coalesce("w.path", "c.path").alias("path"), status.alias("status"), F.col("w.size"), F.col("w.mtime"), F.col("w.file_id"), F.col("c.content").alias("last_content"))
    # every folder above a missing path, to meet the unreadable ones by an equi-join
    parts = F.split("path", "/")
    above = rows.where("status = 'vanished'").select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_bad"))
    hidden = above.join(errors, "_bad", "left_semi").select("path").distinct().withColumn("_hidden", F.lit(True))
    return rows.join(hidden, "path", "left").withColumn("status", F.when(F.col("_hidden"), "unreadable").otherwise(F.col("status"))).drop("_hidden")


def to_hash(classified: DataFrame) -> DataFrame:
    """One path of each file that has to be read: hard links (equal ids other than 0) are read once."""
    rows = classified.where(F.col("status").isin("new", "changed"))
    return rows.groupBy(F.when(F.col("file_id") != 0, F.struct("file_id", "size", "mtime")).alias("_id"), F.when(F.col("file_id") == 0, F.col("path")).alias("_path")).agg(F.min_by(F.struct("path", "size", "mtime", "file_id"), "path").alias("f")).select("f.*")


def with_contents(classified: DataFrame, hashed: DataFrame) -> DataFrame:
    """The rows of new and changed files with their content: by path, or by the file id of the link that was read."""
    rows = classified.where(F.col("status").isin("new", "changed"))
    by_id = hashed.where("file_id != 0").select("file_id", "size", "mtime", F.col("content").alias("_by_id"))
    by_path = hashed.select("path", F.col("content").alias("_by_path"))
    return rows.join(by_path, "path", "left").join(by_id, ["file_id", "size", "mtime"], "left").select("path", "status", "size", "mtime", "file_id", "last_content", F.coalesce("_by_path", "_by_id").alias("content"))


def events(classified: DataFrame, hashed: DataFrame, root: str) -> DataFrame:
    """Events of a pass without clock: observed (content, path, size, mtime), vanished (path, last_content), pass_completed."""
    seen = with_contents(classified, hashed).where(F.col("content").isNotNull())
    observed = seen.select(F.lit("observed").alias("action"), "content", "path", "size", "mtime")
    vanished = classified.where("status = 'vanished'").select(F.lit("vanished").alias("action"), "path", "last_content")
    walked = classified.where(F.col("status").isin("new", "changed", "unchanged"))
    done = walked.agg(F.count("*").alias("files_seen"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes_seen")).select(F.lit("pass_completed").alias("action"), F.lit(root).alias("root"), "files_seen", "bytes_seen")
    return observed.unionByName(vanished, allowMissingColumns=True).unionByName(done, allowMissingColumns=True)


def next_catalog(catalog: DataFrame, classified: DataFrame, hashed: DataFrame, root: str, now: int) -> DataFrame:
    """The catalog after the pass: other roots as they were, vanished paths gone, new and changed ones as walked."""
    seen = with_contents(classified, hashed).where(F.col("content").isNotNull()).select("path", "content", "size", "mtime", "file_id", F.lit(now).cast("long").alias("last_scan"))
    gone = classified.where("status = 'vanished'").select("path")
    stay = catalog.where(~under(F.col("path"), root)).unionByName(catalog.where(under(F.col("path"), root)).join(seen.select("path").union(gone), "path", "left_anti"))
    return stay.unionByName(seen)
