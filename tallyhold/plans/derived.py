"""An inventory log, catalogs and manifests derived from the supplied tables, as DataFrames and as DuckDB SQL.

events -> a log: machine = user_id, path = one of twenty by the number in props, hlc = microseconds of ts * 1000 plus
event_id mod 1000, content = hash of the value's integer part; view and click observe, error vanishes what was seen
there last (dropped where nothing was), purchase backs up, signup completes a pass. Sequence numbers count what is left.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyhold.errors import ConfigError
from tallyhold.operators.chain import number
from tallyhold.schemas import LOG


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The URI of a new folder, where driver and executors see the same: below ``spark.checkpoint.dir``, as the session names
    it, or a temporary one of a session that runs in one process."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ConfigError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tallyhold-")
    return f"{place.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def inventory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    # timestamps have no zone: microseconds are taken without one
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    value = F.floor("value").cast("long")
    kind = F.when(F.col("event_type").isin("view", "click"), "observed").when(F.col("event_type") == "error", "vanished").when(F.col("event_type") == "purchase", "backed").otherwise("pass_completed")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("machine"), (micros * 1000 + F.col("event_id") % 1000).alias("hlc"), kind.alias("action"), F.concat(F.lit("/p/"), (k % 20).cast("string")).alias("at"), F.sha2(value.cast("string"), 256).alias("of"), value.alias("v"), k.alias("k"))
    seen = F.last(F.when(F.col("action") == "observed", F.col("of")), ignorenulls=True)
    rows = rows.withColumn("before", seen.over(W.partitionBy("machine", "at").orderBy("hlc").rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.where((F.col("action") != "vanished") | F.col("before").isNotNull())

    def only(actions: list[str], value: F.Column) -> F.Column:
        return F.when(F.col("action").isin(actions), value)

    rows = rows.select(
        "machine", "hlc", "action",
        only(["observed", "backed"], F.col("of")).alias("content"), only(["observed", "vanished"], F.col("at")).alias("path"), only(["observed"], F.col("v") * 10 + 1).alias("size"), only(["observed"], F.col("hlc") - 1000).alias("mtime"), only(["vanished"], F.col("before")).alias("last_content"),
        only(["pass_completed"], F.concat(F.lit("/r/"), (F.col("k") % 3).cast("string"))).alias("root"), only(["pass_completed"], F.col("k")).alias("files_seen"), only(["pass_completed"], F.col("v")).alias("bytes_seen"),
    )
    empty = spark.createDataFrame([], LOG)
    return number(empty.drop("seq").unionByName(rows, allowMissingColumns=True)).select(*empty.columns)


LOG_SQL = """
base AS (
  SELECT CAST(user_id AS VARCHAR) AS machine, epoch_us(ts) * 1000 + event_id % 1000 AS hlc,
    CASE WHEN event_type IN ('view', 'click') THEN 'observed' WHEN event_type = 'error' THEN 'vanished'
         WHEN event_type = 'purchase' THEN 'backed' ELSE 'pass_completed' END AS action,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v
  FROM events),
named AS (SELECT *, '/p/' || CAST(k % 20 AS VARCHAR) AS spot, sha256(CAST(v AS VARCHAR)) AS hsh FROM base),
prior AS (
  SELECT *, last_value(CASE WHEN action = 'observed' THEN hsh END IGNORE NULLS) OVER (
    PARTITION BY machine, spot ORDER BY hlc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM named),
log AS (
  SELECT machine, row_number() OVER (PARTITION BY machine ORDER BY hlc) - 1 AS seq, hlc, action,
    CASE WHEN action IN ('observed', 'backed') THEN hsh END AS content,
    CASE WHEN action IN ('observed', 'vanished') THEN spot END AS path,
    CASE WHEN action = 'observed' THEN v * 10 + 1 END AS size,
    CASE WHEN action = 'observed' THEN hlc - 1000 END AS mtime,
    CASE WHEN action = 'vanished' THEN before END AS last_content,
    CASE WHEN action = 'pass_completed' THEN '/r/' || CAST(k % 3 AS VARCHAR) END AS root,
    CASE WHEN action = 'pass_completed' THEN k END AS files_seen,
    CASE WHEN action = 'pass_completed' THEN v END AS bytes_seen
  FROM prior WHERE action <> 'vanished' OR before IS NOT NULL)"""

LOCATION_SQL = """
location_state AS (
  SELECT machine, path, hlc AS last_hlc, seq AS last_seq, CASE WHEN action = 'observed' THEN 'live' ELSE 'tombstoned' END AS state,
    coalesce(content, last_content) AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY machine, path ORDER BY hlc DESC, seq DESC) AS rn FROM log WHERE action IN ('observed', 'vanished'))
  WHERE rn = 1)"""

CONTENT_SQL = """
content_index AS (
  SELECT m.content, m.size, coalesce(l.n, 0) AS live, coalesce(l.places, '') AS places, m.backed_up, m.first_seen, m.last_seen
  FROM (SELECT content, coalesce(max(CASE WHEN action = 'observed' THEN size END), 0) AS size, bool_or(action = 'backed') AS backed_up,
          coalesce(min(CASE WHEN action = 'observed' THEN hlc END), 0) AS first_seen, coalesce(max(CASE WHEN action = 'observed' THEN hlc END), 0) AS last_seen
        FROM log WHERE action IN ('observed', 'backed') GROUP BY content) m
  LEFT JOIN (SELECT content, count(*) AS n, string_agg(machine || ':' || path, ',' ORDER BY machine, path) AS places
             FROM location_state WHERE state = 'live' GROUP BY content) l ON m.content = l.content)"""


def with_log(query: str, *more: str) -> str:
    return "WITH " + ",".join([LOG_SQL, *more]) + query


def catalog_and_walk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents as a catalogue, and a later walk: every tenth gone, every seventh grown, every eleventh new as well."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size"))
    zero = F.lit(0).cast("long")
    catalog = docs.select("path", F.sha2(F.col("doc_id").cast("string"), 256).alias("content"), "size", (F.col("doc_id") * 1000).alias("mtime"), (F.col("doc_id") + 1).alias("file_id"), zero.alias("last_scan"))
    stay = docs.where("doc_id % 10 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (F.col("doc_id") * 1000).alias("mtime"), (F.col("doc_id") + 1).alias("file_id"))
    new = docs.where("doc_id % 11 = 0").select(F.concat("path", F.lit(".new")).alias("path"), "size", (F.col("doc_id") * 1000).alias("mtime"), zero.alias("file_id"))
    return catalog, stay.unionByName(new).withColumn("error", F.lit(None).cast("string"))


SCAN_SQL = """
docs AS (SELECT doc_id, '/' || source || '/' || CAST(doc_id AS VARCHAR) AS path, strlen(text) AS size FROM documents),
catalog AS (SELECT path, size, doc_id * 1000 AS mtime, doc_id + 1 AS file_id, sha256(CAST(doc_id AS VARCHAR)) AS content FROM docs),
walk AS (
  SELECT path, CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size, doc_id * 1000 AS mtime, doc_id + 1 AS file_id FROM docs WHERE doc_id % 10 <> 0
  UNION ALL SELECT path || '.new', size, doc_id * 1000, 0 FROM docs WHERE doc_id % 11 = 0)"""
