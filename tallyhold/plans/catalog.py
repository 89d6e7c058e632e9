"""Registered queries of the inventory engine over the supplied tables, each with the SQL that DuckDB runs for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyhold.functions import hashing
from tallyhold.functions.clock import ticked
from tallyhold.functions.crypto import Encrypt
from tallyhold.operators import chain, chunking, inventory, projection, scan
from tallyhold.plans.derived import CONTENT_SQL, LOCATION_SQL, SCAN_SQL, catalog_and_walk, inventory_log, table, with_log

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: A fixed instant after all events, for ages.
NOW = 2_000_000_000 * 10**9


def adder(queries: dict[str, Query], twins: dict[str, str]) -> Callable:
    """A decorator that registers a query, with the SQL that gives the same rows."""

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                twins[f.__name__] = sql
            return f

        return add

    return query


_query = adder(_QUERIES, _SQL)


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.location_state(projection.location_events(inventory_log(spark, sf_dir)))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.fold(inventory_log(spark, sf_dir)).contents


def _flat(contents: DataFrame) -> DataFrame:
    """Live locations as a text, so that engines compare alike."""
    places = F.array_join(F.transform("live_locations", lambda x: F.concat(x["machine"], F.lit(":"), x["path"])), ",")
    return contents.select("content", "size", F.size("live_locations").cast("long").alias("live"), places.alias("places"), "backed_up", "first_seen", "last_seen")


CONTENTS = "SELECT content, size, live, places, backed_up, first_seen, last_seen FROM content_index"


@_query(with_log(" SELECT machine, seq, hlc, action, content, path, size, mtime, last_content, root, files_seen, bytes_seen FROM log"))
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1, WIN1: all machines' events, numbered."""
    return inventory_log(spark, sf_dir).drop("state_hash", "prev", "hash", "sig")


@_query(with_log(" SELECT machine, path, last_hlc, last_seq, state, content FROM location_state", LOCATION_SQL))
def location_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1, JN9: the last writer of each location."""
    return _locations(spark, sf_dir)


@_query(with_log(" " + CONTENTS, LOCATION_SQL, CONTENT_SQL))
def content_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2-5, SRC6: what is known of each content."""
    return _flat(_contents(spark, sf_dir))


@_query(with_log(f" {CONTENTS} WHERE live > 1", LOCATION_SQL, CONTENT_SQL))
def dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1, FLT3: contents in several places."""
    found = projection.fold(inventory_log(spark, sf_dir))
    return _flat(projection.listed(inventory.duplicates(found.counts), found.locations))


@_query(with_log(f" {CONTENTS} WHERE live = 0 AND backed_up", LOCATION_SQL, CONTENT_SQL))
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT2, FLT4: contents backed up that no place has any more."""
    found = projection.fold(inventory_log(spark, sf_dir))
    return inventory.orphans(found.counts).withColumn("places", F.lit(""))


@_query(with_log(" SELECT machine, path, last_hlc, last_seq, state, content FROM location_state WHERE content = sha256('1')", LOCATION_SQL))
def locate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT5: all places of a content, live or not."""
    return inventory.history(_locations(spark, sf_dir), F.sha2(F.lit("1"), 256))


@_query(with_log(" SELECT content, machine, path FROM location_state WHERE state = 'live' AND content = sha256('1')", LOCATION_SQL))
def live_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT6, SRC7: live places of a content that the index has."""
    return inventory.live_locations(_contents(spark, sf_dir), F.sha2(F.lit("1"), 256))


@_query(with_log(" SELECT path, max_by(content, machine) AS content FROM location_state WHERE state = 'live' GROUP BY path", LOCATION_SQL))
def resolve_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT7: the content at each path, of the greatest machine where several have it."""
    return projection.path_to_content(_locations(spark, sf_dir), by_machine=False)


@_query(
    with_log(
        """, paths AS (SELECT path, max_by(content, machine) AS content FROM location_state WHERE state = 'live' GROUP BY path),
targets AS (SELECT DISTINCT path AS target FROM location_state UNION SELECT upper(sha256('1')) UNION SELECT '/nowhere')
SELECT target, CASE WHEN regexp_full_match(target, '[0-9a-fA-F]{64}') THEN lower(target) ELSE p.content END AS content FROM targets LEFT JOIN paths p ON target = p.path""",
        LOCATION_SQL,
    )
)
def resolve_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT8: what a user's target means, a hash or a path."""
    found = _locations(spark, sf_dir)
    more = spark.range(1).select(F.explode(F.array(F.upper(F.sha2(F.lit("1"), 256)), F.lit("/nowhere"))).alias("target"))
    return inventory.resolve(projection.path_to_content(found, by_machine=False), found.select(F.col("path").alias("target")).union(more).distinct())


@_query(
    with_log(
        " SELECT count(*) AS contents, CAST(sum(live) AS BIGINT) AS locations, count(*) FILTER (live > 1) AS duplicates, count(*) FILTER (backed_up AND live = 0) AS orphans, CAST(sum(CASE WHEN backed_up THEN size ELSE 0 END) AS BIGINT) AS backed_bytes FROM content_index",
        LOCATION_SQL,
        CONTENT_SQL,
    )
)
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9: totals."""
    return inventory.totals(projection.fold(inventory_log(spark, sf_dir)).counts)


@_query(with_log(" SELECT root, arg_max(files_seen, hlc) AS files_seen, arg_max(bytes_seen, hlc) AS bytes_seen, max(hlc) AS last_pass_hlc FROM log WHERE action = 'pass_completed' GROUP BY root"))
def pass_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6: the latest pass of each root."""
    return projection.pass_stats(inventory_log(spark, sf_dir))


@_query(with_log(" SELECT machine, max(seq) AS seq FROM log GROUP BY machine"))
def chain_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7: the last event of each log."""
    return projection.chain_tips(inventory_log(spark, sf_dir)).select("machine", "seq")


@_query(with_log(" SELECT DISTINCT machine FROM log"))
def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9, SET3: who has pushed."""
    return inventory_log(spark, sf_dir).select("machine").distinct()


RETENTION = f"""SELECT c.content, c.size, t.last_vanished, CAST({NOW} - t.last_vanished AS BIGINT) AS age_ns FROM content_index c
JOIN (SELECT content, max(last_hlc) AS last_vanished FROM location_state WHERE state = 'tombstoned' GROUP BY content) t ON c.content = t.content
WHERE c.backed_up AND c.live = 0 AND {NOW} - t.last_vanished >= 86400000000000"""


@_query(with_log(" " + RETENTION, LOCATION_SQL, CONTENT_SQL))
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11, JN7, AGG12, ORD1: orphans that may go."""
    found = projection.fold(inventory_log(spark, sf_dir))
    return inventory.retention(found.counts, found.locations, NOW, 86_400)


@_query(with_log(", manifests AS (SELECT DISTINCT content FROM log WHERE action = 'backed'), going AS (" + RETENTION + ") SELECT content FROM manifests WHERE content NOT IN (SELECT content FROM going)", LOCATION_SQL, CONTENT_SQL))
def gc_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12, SNK5: manifests that a collection leaves."""
    return inventory.collected(inventory_log(spark, sf_dir).where("action = 'backed'").select("content").distinct(), retention(spark, sf_dir))


@_query(with_log(" SELECT i.content, i.size, min(l.path) AS path FROM content_index i JOIN location_state l ON i.content = l.content AND l.state = 'live' AND l.machine = '1' WHERE NOT i.backed_up GROUP BY i.content, i.size", LOCATION_SQL, CONTENT_SQL))
def backup_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11, LIM2, JN4: what machine 1 has to back up."""
    found = projection.fold(inventory_log(spark, sf_dir))
    return inventory.backup_worklist(found.facts, found.locations, "1")


SEGMENTS_SQL = "\nsegments AS (SELECT machine, (seq // 16) * 16 AS seq_start, max(seq) AS seq_end, count(*) AS n FROM log GROUP BY machine, seq // 16)"


def _segments(log: DataFrame) -> DataFrame:
    return log.groupBy("machine", (F.floor(F.col("seq") / 16) * 16).cast("long").alias("seq_start")).agg(F.max("seq").alias("seq_end"), F.count("*").alias("n"))


@_query(with_log(" SELECT machine, seq_start, seq_end, n FROM segments", SEGMENTS_SQL))
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18, SRC8, ORD2: segments of sixteen events."""
    return _segments(inventory_log(spark, sf_dir))


@_query(with_log(", synced AS (SELECT machine, 15 AS last_seq FROM segments WHERE CAST(machine AS BIGINT) % 2 = 0 GROUP BY machine) SELECT s.machine, s.seq_start, s.seq_end, s.n FROM segments s LEFT JOIN synced y ON s.machine = y.machine WHERE y.last_seq IS NULL OR s.seq_start > y.last_seq", SEGMENTS_SQL))
def pull_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT12, JN8: segments that are still to be taken, even machines being synced up to event 15."""
    found = _segments(inventory_log(spark, sf_dir))
    synced = found.where(F.col("machine").cast("long") % 2 == 0).select("machine").distinct().withColumn("last_seq", F.lit(15).cast("long"))
    return inventory.new_segments(found, synced)


@_query(with_log(", tips AS (SELECT machine, max(seq) - 20 AS tip FROM log WHERE CAST(machine AS BIGINT) % 3 = 0 GROUP BY machine) SELECT s.machine, s.seq_start, s.seq_end, s.n FROM segments s LEFT JOIN tips t ON s.machine = t.machine WHERE t.tip IS NULL OR s.seq_end > t.tip", SEGMENTS_SQL))
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT13: segments that a snapshot doesn't make needless."""
    log = inventory_log(spark, sf_dir)
    tips = log.where(F.col("machine").cast("long") % 3 == 0).groupBy("machine").agg((F.max("seq") - 20).alias("seq"))
    return inventory.unneeded_dropped(_segments(log), tips)


SIZED = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
BODY_SQL = " || ".join(SIZED.format(c) if c != "state_hash" else "'-'" for c in ("machine", "seq", "hlc", "action", "content", "path", "size", "mtime", "last_content", "root", "files_seen", "bytes_seen", "state_hash"))


@_query(with_log(f", bodies AS (SELECT machine, seq, sha256({BODY_SQL}) AS body FROM log), lists AS (SELECT machine, count(*) AS n, list(body ORDER BY seq) AS bodies FROM bodies GROUP BY machine) SELECT machine, n, list_reduce(list_prepend(repeat('0', 64), bodies), lambda acc, x: sha256(acc || x)) AS tip FROM lists"))
def entry_hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN4, WIN3, SNK1: each machine's chain, down to its last hash."""
    found = chain.linked(inventory_log(spark, sf_dir))
    return found.groupBy("machine").agg(F.count("*").alias("n"), F.max_by("hash", "seq").alias("tip"))


@_query(with_log(" SELECT machine, CAST(NULL AS VARCHAR) AS error, n FROM (SELECT machine, count(*) AS n FROM log GROUP BY machine)"))
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6, T13, WIN2-4, JN10, FN5: every machine's chain checked from its first event; none has a fault."""
    rows = chain.linked(inventory_log(spark, sf_dir)).withColumns({"segment": F.col("machine"), "ord": F.col("seq")})
    heads = chain.segment_headers(rows)
    named = heads.select(F.col("machine").alias("segment"), F.col("machine").alias("owner"), "seq_start", "seq_end", "tip_hash")
    return chain.verify(rows, named).join(heads.select(F.col("machine").alias("segment"), "n"), "segment").select(F.col("owner").alias("machine"), "error", "n")


FAULTS = "['" + "', '".join(chain.PRECEDENCE) + "']"
FAULT_SEQ = "CASE CAST(machine AS BIGINT) % 14 WHEN 8 THEN 2 WHEN 9 THEN 3 WHEN 10 THEN 2 WHEN 11 THEN 2 WHEN 12 THEN 0 END"


@_query(with_log(f" SELECT machine, list_extract({FAULTS}, CAST(CAST(machine AS BIGINT) % 14 AS BIGINT) + 1) AS error, CAST({FAULT_SEQ} AS BIGINT) AS error_seq FROM (SELECT machine, count(*) AS n FROM log GROUP BY machine) WHERE n > 5"))
def chain_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6: each machine's chain with another fault, by its number, each of the thirteen kinds or none; the faults found."""
    rows = chain.linked(inventory_log(spark, sf_dir))
    heads = chain.segment_headers(rows).where("n > 5")
    kind, at = F.col("machine").cast("long") % 14, F.col("seq")
    other = F.lit("f" * 64)
    # entries taken out: all, the first, the last, the third
    rows = rows.join(heads.select("machine", F.col("seq_end").alias("_last")), "machine")
    rows = rows.where(~((kind == 0) | (kind.isin(1, 5, 7) & (at == 0)) | ((kind == 2) & (at == F.col("_last"))) | ((kind == 9) & (at == 2)))).drop("_last")
    rows = rows.withColumns(
        {
            "segment": F.col("machine"),
            "ord": at,
            "prev": F.when((kind == 4) & (at == 0), other).when((kind == 10) & (at == 2), F.reverse("prev")).otherwise(F.col("prev")),
            "hlc": F.when((kind == 11) & (at == 2), F.col("hlc") + 1).otherwise(F.col("hlc")),
            "machine": F.when((kind == 8) & (at == 2), F.lit("other")).otherwise(F.col("machine")),
        }
    )
    named = heads.select(
        F.col("machine").alias("segment"),
        F.col("machine").alias("owner"),
        F.when(kind.isin(5, 7), 1).otherwise(F.col("seq_start")).cast("long").alias("seq_start"),
        "seq_end",
        F.when(kind == 3, F.reverse("tip_hash")).otherwise(F.col("tip_hash")).alias("tip_hash"),
        F.when(kind.isin(6, 7), other).alias("known"),
    )
    # entries of this log have no signatures, which only those of one kind are asked for
    signed = F.col("owner").cast("long") % 14 == 12
    found = chain.verify(rows, named.where(~signed)).unionByName(chain.verify(rows, named.where(signed), signatures=True))
    return found.select(F.col("owner").alias("machine"), "error", "error_seq")


@_query("SELECT conv_id AS machine, turn AS seq, before AS previous_seq FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE turn % 4 <> 2) WHERE turn - before <> 1")
def chain_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2: gaps, in conversations that lack every fourth turn."""
    return chain.gaps(table(spark, sf_dir, "conversations").where("turn % 4 <> 2").select(F.col("conv_id").alias("machine"), F.col("turn").alias("seq")))


@_query("SELECT user_id AS machine, seq, hlc, before AS previous_hlc FROM (SELECT *, lag(hlc) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM (SELECT user_id, event_id % 97 * 1000000000 + event_id AS seq, epoch_us(ts) AS hlc FROM events)) WHERE hlc <= before")
def hlc_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6: events, in an order other than theirs, whose time goes back."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return chain.clock_faults(table(spark, sf_dir, "events").select(F.col("user_id").alias("machine"), (F.col("event_id") % 97 * 1_000_000_000 + F.col("event_id")).alias("seq"), micros.alias("hlc")))


@_query("SELECT user_id AS machine, event_id, max(wall - n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + n AS hlc FROM (SELECT user_id, event_id, epoch_us(ts) // 3600000000 AS wall, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def hlc_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN7: clock values over a wall clock of hours."""
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) div 3600000000")
    return ticked(table(spark, sf_dir, "events").select(F.col("user_id").alias("machine"), "event_id", hours.alias("wall")), "wall", order=["event_id"]).select("machine", "event_id", "hlc")


@_query(
    "WITH "
    + SCAN_SQL
    + """ SELECT coalesce(w.path, c.path) AS path, CASE WHEN w.path IS NULL THEN 'vanished' WHEN c.path IS NULL THEN 'new'
WHEN w.size = c.size AND w.mtime = c.mtime AND (w.file_id = 0 OR c.file_id = 0 OR w.file_id = c.file_id) THEN 'unchanged' ELSE 'changed' END AS status, w.size, w.mtime, w.file_id, c.content AS last_content
FROM walk w FULL OUTER JOIN catalog c ON w.path = c.path"""
)
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, JN2, SET2, FLT9: a walk against the catalogue."""
    catalog, walk = catalog_and_walk(spark, sf_dir)
    return scan.classify(walk, catalog)


@_query("WITH " + SCAN_SQL + " SELECT count(*) AS files_seen, CAST(sum(size) AS BIGINT) AS bytes_seen FROM walk")
def pass_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10, AGG11: what a pass reports."""
    catalog, walk = catalog_and_walk(spark, sf_dir)
    found = scan.classify(walk, catalog)
    done = scan.events(found, found.where("false").select("path", "size", "mtime", "file_id", F.lit("").alias("content")), "/")
    return done.where("action = 'pass_completed'").select("files_seen", "bytes_seen")


@_query("WITH " + SCAN_SQL + " SELECT path, content, size FROM catalog WHERE path = '/src1' OR starts_with(path, '/src1/')")
def path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5, FLT14: the catalogue below a root, which isn't a mere beginning of its name."""
    return inventory.under_root(catalog_and_walk(spark, sf_dir)[0], "/src1").select("path", "content", "size")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))


@_query("SELECT sha256(text) AS content, count(*) AS files, max(strlen(text)) AS size, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN1, AGG15, SRC4: documents by content."""
    return _documents(spark, sf_dir).groupBy(hashing.content_hash(F.col("data")).alias("content")).agg(F.count("*").alias("files"), F.max(F.octet_length("data")).cast("long").alias("size"), F.min("doc_id").alias("first_doc"))


def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content, data of the documents, each content once: chosen by hash and key, so that no text is shuffled to find its equals."""
    docs = _documents(spark, sf_dir).withColumn("content", hashing.content_hash(F.col("data")))
    chosen = docs.where("content is not null").groupBy("content").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(chosen, "doc_id", "left_semi").select("content", "data")


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.stored(chunking.chunks(_distinct(spark, sf_dir), 1024))


DISTINCT_DOCS = "SELECT DISTINCT sha256(text) AS content, strlen(text) AS total_size FROM documents WHERE strlen(text) > 0"


@_query(f"SELECT content, total_size, true AS covered FROM ({DISTINCT_DOCS})")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T2, WIN5, WIN7: chunks follow each other and cover their content."""
    rows = chunking.plain_lengths(chunking.refs(_cut(spark, sf_dir), 1))
    return chunking.coverage(rows).join(rows.groupBy("content").agg(F.max("total_size").alias("total_size")), "content").select("content", "total_size", "covered")


@_query(f"SELECT content, CAST(1 AS INTEGER) AS version, total_size, true AS in_order FROM ({DISTINCT_DOCS})")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, FN9: manifests with their chunks in order."""
    found = chunking.manifests(chunking.refs(_cut(spark, sf_dir), 1))
    offsets = F.transform("chunks", lambda x: x["offset"])
    return found.select("content", hashing.supported(F.col("version")).alias("version"), "total_size", (F.array_sort(offsets) == offsets).alias("in_order"))


@_query(f"SELECT content, content AS restored_hash, CAST(NULL AS VARCHAR) AS error FROM ({DISTINCT_DOCS})")
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5, JN6, SRC11: documents cut, encrypted, stored, fetched, decrypted, put together and verified."""
    found = _distinct(spark, sf_dir)
    own = Encrypt(bytes(range(32)))
    cut = chunking.stored(chunking.chunks(found, 1024), own)
    got = chunking.restored(chunking.refs(cut, 1), cut.select("chunk_id", "data").dropDuplicates(["chunk_id"]), own)
    return got.select("content", hashing.content_hash(F.col("data")).alias("restored_hash"), "error")


@_query("SELECT count(*) AS refs, count(DISTINCT line) AS distinct_chunks, count(DISTINCT line) / count(*) AS ratio FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14, SET5: how much is saved if lines are the chunks."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    kinds = lines.groupBy("line").agg(F.count("*").alias("n"))
    return kinds.agg(F.sum("n").alias("refs"), F.count("*").alias("distinct_chunks")).select("refs", "distinct_chunks", (F.col("distinct_chunks") / F.col("refs")).alias("ratio"))


LINES_SQL = """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), ids AS (SELECT doc_id, sha256(line) AS chunk_id, strlen(line) AS size FROM lines),
stored AS (SELECT DISTINCT chunk_id FROM ids WHERE doc_id % 2 = 0), fresh AS (SELECT * FROM ids WHERE doc_id % 2 = 1)"""


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    ids = lines.select("doc_id", F.sha2("line", 256).alias("chunk_id"), F.octet_length("line").cast("long").alias("size"))
    return ids.where("doc_id % 2 = 1"), ids.where("doc_id % 2 = 0").select("chunk_id").distinct()


@_query(LINES_SQL + " SELECT DISTINCT chunk_id, size FROM fresh WHERE chunk_id NOT IN (SELECT chunk_id FROM stored)")
def put_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3, JN5, SRC12: lines of odd documents that even ones don't have."""
    fresh, stored = _lines(spark, sf_dir)
    return chunking.absent(fresh, stored).select("chunk_id", "size")


@_query(LINES_SQL + " SELECT (SELECT count(*) FROM fresh) AS chunks_total, (SELECT CAST(sum(size) AS BIGINT) FROM fresh) AS bytes_total, count(*) AS chunks_uploaded, CAST(sum(size) AS BIGINT) AS bytes_uploaded FROM (SELECT DISTINCT chunk_id, size FROM fresh WHERE chunk_id NOT IN (SELECT chunk_id FROM stored))")
def backup_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13: chunks and bytes in all and sent."""
    return chunking.accounting(*_lines(spark, sf_dir))


@_query(LINES_SQL + " SELECT DISTINCT chunk_id FROM fresh INTERSECT SELECT chunk_id FROM stored")
def shared_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET4: chunks that two versions share."""
    fresh, stored = _lines(spark, sf_dir)
    return fresh.select("chunk_id").intersect(stored)


@_query("WITH refs AS (SELECT l_orderkey AS content, l_linenumber AS ordinal, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(l_linenumber) OVER (PARTITION BY l_orderkey) AS total FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) SELECT content, ordinal, CAST(coalesce(before, 0) AS BIGINT) AS off, CAST(coalesce(lead(coalesce(before, 0)) OVER (PARTITION BY content ORDER BY ordinal), total) - coalesce(before, 0) AS BIGINT) AS length FROM refs")
def manifest_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5: plain lengths from offsets, order lines as chunks of as many bytes as their number."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("content"), F.col("l_linenumber").alias("ordinal")).distinct()
    w = W.partitionBy("content")
    before = F.coalesce(F.sum("ordinal").over(w.orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"offset": before.cast("long"), "total_size": F.sum("ordinal").over(w).cast("long")})
    return chunking.plain_lengths(rows).select("content", "ordinal", F.col("offset").alias("off"), "length")


@_query(
    with_log(
        """, rows AS (SELECT sha256(concat_ws('|', 'c', content, size, CAST(backed_up AS VARCHAR), first_seen, last_seen)) AS h FROM content_index
UNION ALL SELECT sha256(concat_ws('|', 'l', content, machine, path)) FROM location_state WHERE state = 'live'),
sums AS (SELECT k, CAST(sum(CAST('0x' || substr(h, 1 + 7 * k, 7) AS BIGINT)) AS VARCHAR) AS p FROM rows, (SELECT unnest(range(9)) AS k) GROUP BY k)
SELECT sha256((SELECT CAST(count(*) AS VARCHAR) FROM rows) || '|' || string_agg(p, '|' ORDER BY k)) AS state_hash FROM sums""",
        LOCATION_SQL,
        CONTENT_SQL,
    )
)
def state_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16, SNK4, ORD3: a hash of the whole state."""
    return projection.state_hash(projection.fold(inventory_log(spark, sf_dir)))


@_query(with_log(" " + CONTENTS, LOCATION_SQL, CONTENT_SQL))
def snapshot_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15, SNK7: the fold of a snapshot of even events and of all others, odd ones coming twice."""
    log = inventory_log(spark, sf_dir)
    odd = log.where("seq % 2 = 1")
    return _flat(projection.fold(odd.unionByName(odd), projection.fold(log.where("seq % 2 = 0"))).contents)


@_query("SELECT doc_id, strlen(text) + 28 AS stored_size, true AS same, true AS convergent, CAST(NULL AS BLOB) AS by_wrong_key FROM documents")
def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN11, FN12, FN13: chunks encrypted, decrypted, and refused to a wrong key."""
    own, other = Encrypt(bytes(range(32))), Encrypt(bytes(32))
    rows = _documents(spark, sf_dir).withColumns({"stored": own.apply(F.col("data"))})
    return rows.select("doc_id", F.octet_length("stored").cast("long").alias("stored_size"), (own.reverse(F.col("stored")) == F.col("data")).alias("same"), (own.apply(F.col("data")) == F.col("stored")).alias("convergent"), other.reverse(F.col("stored")).alias("by_wrong_key"))


@_query("SELECT doc_id, 'chunks/' || h AS chunk_key, 'manifests/' || h AS manifest_key, 'snapshots/' || h AS snapshot_key, 'log/' || h || '/' || lpad(CAST(doc_id AS VARCHAR), 20, '0') || '.seg' AS segment_key, h AS machine, doc_id AS seq_start FROM (SELECT doc_id, sha256(text) AS h FROM documents)")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN2, FN10, SRC13: names of objects, and of segments read back."""
    rows = _documents(spark, sf_dir).select("doc_id", hashing.content_hash(F.col("data")).alias("h"))
    rows = rows.withColumn("segment_key", hashing.segment_key(F.col("h"), F.col("doc_id"))).withColumn("parsed", hashing.parse_segment_key(F.col("segment_key")))
    return rows.select("doc_id", hashing.chunk_key(F.col("h")).alias("chunk_key"), hashing.manifest_key(F.col("h")).alias("manifest_key"), hashing.snapshot_key(F.col("h")).alias("snapshot_key"), "segment_key", "parsed.machine", "parsed.seq_start")


@_query("SELECT page_id, url AS key, url AS display, false AS escaped, strlen(url) AS n_bytes FROM pages UNION ALL SELECT -1 - page_id, chr(0) || 'ff' || lower(hex(encode(url))), '<bytes:ff' || lower(hex(encode(url))) || '>', true, strlen(url) + 1 FROM pages")
def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN3: paths as keys and back, those of broken UTF-8 escaped."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").cast("binary").alias("raw"))
    rows = rows.unionByName(rows.select((-1 - F.col("page_id")).alias("page_id"), F.concat(F.unhex(F.lit("FF")), "raw").alias("raw")))
    key = hashing.path_key(F.col("raw"))
    return rows.select("page_id", key.alias("key"), hashing.path_display(key).alias("display"), hashing.is_escaped(key).alias("escaped"), F.octet_length(hashing.path_bytes(key)).cast("long").alias("n_bytes"))


def queries() -> dict[str, Query]:
    from tallyhold.plans import scenarios

    return _QUERIES | scenarios.queries()


def oracle_sql() -> dict[str, str]:
    from tallyhold.plans import scenarios

    return _SQL | scenarios.oracle_sql()
