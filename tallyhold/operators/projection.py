"""The fold of machines' logs into what content is where: last writer wins, in any order of arrival.

All of it are mergeable aggregates, so the fold of a snapshot and of new events is the fold of all events. Ties of the
logical clock go to the higher sequence number, then to the later machine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rank() -> Column:
    return F.struct("hlc", "seq")


def location_events(log: DataFrame) -> DataFrame:
    """machine, path, hlc, seq, state, content of the events that say what a location holds."""
    rows = log.where(F.col("action").isin("observed", "vanished"))
    live = F.col("action") == "observed"
    return rows.select("machine", "path", "hlc", "seq", F.when(live, "live").otherwise("tombstoned").alias("state"), F.when(live, F.col("content")).otherwise(F.col("last_content")).alias("content"))


def location_state(events: DataFrame) -> DataFrame:
    """machine, path, last_hlc, last_seq, state, content: the winning event of each location."""
    top = F.max_by(F.struct("state", "content", "seq"), _rank())
    found = events.groupBy("machine", "path").agg(top.alias("top"), F.max("hlc").alias("last_hlc"))
    return found.select("machine", "path", "last_hlc", F.col("top.seq").alias("last_seq"), "top.state", "top.content")


def content_facts(log: DataFrame) -> DataFrame:
    """content, size, backed_up, first_seen, last_seen (null: never observed): merges by max, or, min, max."""
    rows = log.where(F.col("action").isin("observed", "backed"))
    seen = F.when(F.col("action") == "observed", F.col("hlc"))
    return rows.groupBy("content").agg(
        F.coalesce(F.max(F.when(F.col("action") == "observed", F.col("size"))), F.lit(0).cast("long")).alias("size"),
        F.max(F.col("action") == "backed").alias("backed_up"),
        F.min(seen).alias("first_seen"),
        F.max(seen).alias("last_seen"),
    )


def content_index(facts: DataFrame, locations: DataFrame) -> DataFrame:
    """content, size, live_locations (sorted), backed_up, first_seen, last_seen (0: never observed)."""
    live = locations.where("state = 'live'").groupBy("content").agg(F.array_sort(F.collect_set(F.struct("machine", "path"))).alias("live_locations"))
    none = F.array().cast(live.schema["live_locations"].dataType)
    zero = F.lit(0).cast("long")
    return facts.join(live, "content", "left").select("content", "size", F.coalesce("live_locations", none).alias("live_locations"), "backed_up", F.coalesce("first_seen", zero).alias("first_seen"), F.coalesce("last_seen", zero).alias("last_seen"))


def content_counts(facts: DataFrame, locations: DataFrame) -> DataFrame:
    """The content index with a number, live, in place of the locations: what most questions need, and never a long row."""
    live = locations.where("state = 'live'").groupBy("content").agg(F.count("*").alias("live"))
    zero = F.lit(0).cast("long")
    return facts.join(live, "content", "left").select("content", "size", F.coalesce("live", zero).alias("live"), "backed_up", F.coalesce("first_seen", zero).alias("first_seen"), F.coalesce("last_seen", zero).alias("last_seen"))


def pass_stats(log: DataFrame, *by: str) -> DataFrame:
    """The latest completed pass of each root (of each machine and root, if so asked): files_seen, bytes_seen, last_pass_hlc."""
    keys = by or ("root",)
    rows = log.where("action = 'pass_completed'")
    top = F.max_by(F.struct("files_seen", "bytes_seen"), F.struct("hlc", "machine", "seq"))
    return rows.groupBy(*keys).agg(top.alias("top"), F.max("hlc").alias("last_pass_hlc")).select(*keys, "top.files_seen", "top.bytes_seen", "last_pass_hlc")


def chain_tips(log: DataFrame) -> DataFrame:
    """machine, seq, hash of each log's last event."""
    return log.groupBy("machine").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def last_snapshot(log: DataFrame) -> DataFrame:
    """state_hash of the latest snapshot event; no row without one."""
    return log.where("action = 'snapshot'").agg(F.max_by("state_hash", F.struct("hlc", "machine", "seq")).alias("state_hash")).where(F.col("state_hash").isNotNull())


def path_to_content(locations: DataFrame, *, by_machine: bool = True) -> DataFrame:
    """path, content (and machine) of live locations; without machines a path on several goes to the greatest machine."""
    live = locations.where("state = 'live'")
    if by_machine:
        return live.select("machine", "path", "content")
    return live.groupBy("path").agg(F.max_by("content", "machine").alias("content"))


@dataclass(frozen=True)
class Projection:
    """What the logs say, as tables."""

    locations: DataFrame
    facts: DataFrame
    passes: DataFrame
    tips: DataFrame

    @property
    def contents(self) -> DataFrame:
        return content_index(self.facts, self.locations)

    @property
    def counts(self) -> DataFrame:
        return content_counts(self.facts, self.locations)

    def tables(self) -> dict[str, DataFrame]:
        return {"locations": self.locations, "facts": self.facts, "passes": self.passes, "tips": self.tips}


def fold(log: DataFrame, onto: Projection | None = None) -> Projection:
    """The projection of a log, or of a snapshot and the events since; events that the snapshot has may come again."""
    own = Projection(location_state(location_events(log)), content_facts(log), pass_stats(log, "machine", "root"), chain_tips(log))
    return merged([onto, own]) if onto else own


def merged(parts: list[Projection]) -> Projection:
    """The projection of all events that any of these are projections of."""

    def all_of(name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (getattr(p, name) for p in parts))

    places = all_of("locations").select("machine", "path", F.col("last_hlc").alias("hlc"), F.col("last_seq").alias("seq"), "state", "content")
    facts = all_of("facts").groupBy("content").agg(F.max("size").alias("size"), F.max("backed_up").alias("backed_up"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    top = F.max_by(F.struct("files_seen", "bytes_seen"), "last_pass_hlc")
    passes = all_of("passes").groupBy("machine", "root").agg(top.alias("top"), F.max("last_pass_hlc").alias("last_pass_hlc")).select("machine", "root", "top.files_seen", "top.bytes_seen", "last_pass_hlc")
    tips = all_of("tips").groupBy("machine").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
    return Projection(location_state(places), facts, passes, tips)


def listed(contents: DataFrame, locations: DataFrame) -> DataFrame:
    """Contents with a number (``content_counts``), or some of them, with the list of their live locations in place of it."""
    return content_index(contents.drop("live"), locations.join(contents.select("content"), "content", "left_semi"))


def state_hash(found: Projection) -> DataFrame:
    """One row: a hash of the content index that doesn't depend on the order of anything.

    Facts and live locations are rows, each hashed by itself, so a content may have any number of places. The hashes are added
    up in pieces of seven digits, which merge like any sum, and the sums hashed.
    """
    zero = F.lit(0).cast("long")
    facts = found.facts.select(F.concat_ws("|", F.lit("c"), "content", "size", "backed_up", F.coalesce("first_seen", zero), F.coalesce("last_seen", zero)).alias("row"))
    places = found.locations.where("state = 'live'").select(F.concat_ws("|", F.lit("l"), "content", "machine", "path").alias("row"))
    pieces = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 7 * k, 7), 16, 10).cast("long")), F.lit(0)).alias(f"p{k}") for k in range(9)]
    sums = facts.unionByName(places).select(F.sha2("row", 256).alias("h")).agg(F.count("*").alias("n"), *pieces)
    return sums.select(F.sha2(F.concat_ws("|", "n", *(f"p{k}" for k in range(9))), 256).alias("state_hash"))
