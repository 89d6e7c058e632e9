"""The fold as a stream: events of a growing log folder, last writer wins per location.

State is Spark's own keyed aggregation (max_by in its state store), so no Python runs for a row, and an event that
comes late or twice can't change what a later one said. There is no watermark on purpose: late events count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyhold.operators import projection
from tallyhold.schemas import LOG
from tallyhold.sources.store import Store


def log_stream(spark: SparkSession, uri: str, *, files_per_batch: int | None = None) -> DataFrame:
    """Events of all machines as their segments arrive under ``uri``/log."""
    reader = spark.readStream.schema(f"{LOG}, seq_start long")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{uri.rstrip('/')}/log")


def live_locations(log: DataFrame) -> DataFrame:
    """The winning state of each location, for update (changed locations) or complete mode."""
    return projection.location_state(projection.location_events(log))


def windowed_activity(log: DataFrame, width: str = "5 minutes", late: str = "1 day") -> DataFrame:
    """Events of each kind in windows of the logical clock, which is event time here; for append mode, late events dropped."""
    rows = log.withColumn("at", F.timestamp_micros(F.floor(F.col("hlc") / 1000).cast("long"))).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("window"), "action").agg(F.count("*").alias("events")).select("window.start", "window.end", "action", "events")


TABLES = ("locations", "facts", "passes", "tips")


def keep_folded(log: DataFrame, store: Store, checkpoint: str, name: str = "projection", *, compact_after: int = 50, **trigger) -> StreamingQuery:
    """Fold each micro-batch to a projection of its own in the store, which ``folded`` merges; one that is run again replaces itself.

    A batch costs what its events cost. After each ``compact_after`` batches all that there is becomes one base.
    """

    def merge(batch: DataFrame, number: int) -> None:
        for table, df in projection.fold(batch).tables().items():
            df.write.mode("overwrite").parquet(f"{store.uri}/{name}-batches/{number}/{table}")
        if (number + 1) % compact_after == 0:
            compact(store, name)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _parts(store: Store, name: str) -> tuple[projection.Projection | None, dict[int, projection.Projection]]:
    """The base, and the batches that it doesn't have, by number."""
    upto, base = store.current(name, "upto"), None
    last = -1 if upto is None else upto.first().number
    if upto is not None:
        base = projection.Projection(*(store.current(name, t) for t in TABLES))
    numbers = sorted(int(x) for x in store.names(f"{name}-batches") if int(x) > last)
    return base, {n: projection.Projection(*(store.spark.read.parquet(f"{store.uri}/{name}-batches/{n}/{t}") for t in TABLES)) for n in numbers}


def folded(store: Store, name: str = "projection") -> projection.Projection | None:
    """The projection of all batches that ``keep_folded`` has folded; None before the first."""
    base, batches = _parts(store, name)
    parts = [p for p in (base, *batches.values()) if p]
    return projection.merged(parts) if parts else None


def compact(store: Store, name: str = "projection") -> None:
    """Make one base of the base and all batches; the pointer of the base says which batches it has, then these are deleted."""
    base, batches = _parts(store, name)
    if not batches:
        return
    parts = [p for p in (base, *batches.values()) if p]
    upto = store.spark.createDataFrame([(max(batches),)], "number long")
    store.replace(name, projection.merged(parts).tables() | {"upto": upto})
    for n in batches:
        store.drop(f"{name}-batches/{n}")
