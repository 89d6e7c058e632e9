"""Registered queries that go through stores, engines and file trees, each over whole supplied tables, with their SQL."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import astuple
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.functions import crypto
from tallyhold.functions.hashing import content_hash
from tallyhold.operators import chain, chunking, projection, scan
from tallyhold.plans.catalog import BODY_SQL, Query, adder
from tallyhold.plans.derived import inventory_log, scratch, table, with_log
from tallyhold.plans.engine import Engine
from tallyhold.schemas import CATALOG
from tallyhold.sources.config import Config
from tallyhold.sources.store import Store

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_query = adder(_QUERIES, _SQL)
#: Events of a segment in these queries, and the machines whose logs go through stores.
PART, SOME = 16, ("1", "2", "3")


@_query(
    with_log(
        """ SELECT machine AS owner, CASE CAST(machine AS BIGINT) % 4 WHEN 1 THEN 16 WHEN 2 THEN 16 WHEN 3 THEN 0 ELSE n END AS verified,
CASE CAST(machine AS BIGINT) % 4 WHEN 1 THEN 'invalid_hash' WHEN 2 THEN 'last_not_end' WHEN 3 THEN 'tip_mismatch' END AS first_error
FROM (SELECT machine, count(*) AS n FROM log GROUP BY machine) WHERE n > 32"""
    )
)
def check_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4, T13: logs in segments of sixteen, checked against their headers up to the first fault: a field changed in the second
    segment, its last event lost, or the first one's tip changed, by machine."""
    name = F.concat_ws("/", "machine", F.lpad((F.floor(F.col("seq") / PART) * PART).cast("string"), 20, "0"))
    rows = chain.linked(inventory_log(spark, sf_dir)).withColumns({"segment": name, "ord": F.col("seq")})
    heads = chain.segment_headers(rows, "segment").withColumnRenamed("machine", "owner")
    long = heads.groupBy("owner").agg(F.sum("n").alias("all")).where("all > 32").select("owner")
    kind = F.col("owner").cast("long") % 4
    heads = heads.join(long, "owner").withColumn("tip_hash", F.when((kind == 3) & (F.col("seq_start") == 0), F.reverse("tip_hash")).otherwise(F.col("tip_hash")))
    heads = heads.withColumn("known", F.lag("tip_hash").over(chain.W.partitionBy("owner").orderBy("seq_start")))
    kind = F.col("machine").cast("long") % 4
    rows = rows.where(~((kind == 2) & (F.col("seq") == 31))).withColumn("hlc", F.col("hlc") + F.when((kind == 1) & (F.col("seq") == 20), 1).otherwise(0))
    return chain.check_own(chain.verify(rows, heads.select("segment", "owner", "seq_start", "seq_end", "tip_hash", "known")), heads)


@_query(with_log(" SELECT sha256(CAST(hlc AS VARCHAR)) AS state_hash FROM log WHERE action = 'pass_completed' ORDER BY hlc DESC, machine DESC, seq DESC LIMIT 1"))
def last_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8: the latest snapshot's hash, completed passes standing for snapshots."""
    log, done = inventory_log(spark, sf_dir), F.col("action") == "pass_completed"
    return projection.last_snapshot(log.withColumns({"state_hash": F.when(done, F.sha2(F.col("hlc").cast("string"), 256)), "action": F.when(done, "snapshot").otherwise(F.col("action"))}))


LINKS_SQL = "links AS (SELECT '/l/' || CAST(doc_id AS VARCHAR) AS path, doc_id % 3 AS size, doc_id % 40 AS file_id FROM documents)"


@_query(f"WITH {LINKS_SQL} SELECT path, sha256(CASE WHEN file_id = 0 THEN path ELSE min(path) OVER (PARTITION BY file_id, size) END) AS content FROM links")
def hard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3: of the paths of one file id one is read, and all have its content; id 0 is no id."""
    i = F.col("doc_id")
    walk = table(spark, sf_dir, "documents").select(F.concat(F.lit("/l/"), i.cast("string")).alias("path"), (i % 3).alias("size"), (i % 3).alias("mtime"), (i % 40).alias("file_id"), F.lit(None).cast("string").alias("error"))
    found = scan.classify(walk, spark.createDataFrame([], CATALOG))
    read = scan.to_hash(found).withColumn("content", F.sha2("path", 256))
    return scan.with_contents(found, read).select("path", "content")


def _folded(bodies: str) -> str:
    return f"list_reduce(list_prepend(repeat('0', 64), {bodies}), lambda a, b: sha256(a || b))"


@_query(
    with_log(
        f""", bodies AS (SELECT machine, seq, sha256({BODY_SQL}) AS body FROM log WHERE machine IN {SOME}), lists AS (SELECT machine, count(*) AS n, list(body ORDER BY seq) AS b FROM bodies GROUP BY machine)
SELECT machine, CAST(0 AS BIGINT) AS seq_start, least(n, 16) - 1 AS seq_end, {_folded("b[1:16]")} AS tip_hash, least(n, 16) AS n FROM lists
UNION ALL SELECT machine, 16, n - 1, {_folded("b")}, n - 16 FROM lists WHERE n > 16"""
    )
)
def segment_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, SNK11, SRC10, T7: logs of machines 1 to 3 pushed to a new store in two segments each, and their headers as stored."""
    store, rows = Store(spark, scratch(spark)), chain.linked(inventory_log(spark, sf_dir).where(F.col("machine").isin(*SOME)))
    for machine in SOME:
        own = rows.where(F.col("machine") == machine)
        for part in (own.where(F.col("seq") < PART), own.where(F.col("seq") >= PART)):
            if not part.isEmpty():
                store.push(chain.one_segment(part, machine), machine)
    return store.segments()


@_query(with_log(" SELECT CAST(machine AS INTEGER) AS pull, action, count(*) AS n FROM log WHERE machine IN ('1', '2') GROUP BY machine, action"))
def pull_and_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9, T8-T10, FN6: what another machine takes, verified with its signatures: the events of machine 1, then, from where it
    had got to, those of machine 2, which the same log goes on with."""
    place, log, found = scratch(spark), inventory_log(spark, sf_dir), None
    one, two = (Engine(spark, Config([], place), key=bytes([k]) * 32) for k in (1, 2))
    for k, machine in enumerate(SOME[:2], 1):
        one.append(log.where(F.col("machine") == machine).drop("machine", "seq", "hlc", "prev", "hash", "sig"))
        got = two.pull().groupBy(F.lit(k).alias("pull"), "action").agg(F.count("*").alias("n"))
        found = got if found is None else found.unionByName(got)
    return found


TREE_SQL = """WITH tree AS (SELECT doc_id, strlen(text) AS size, text FROM documents WHERE text IS NOT NULL AND doc_id % 13 <> 0),
later AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END AS text FROM tree WHERE doc_id % 10 <> 0)
SELECT 1 AS step, count(*) AS files_seen, CAST(sum(size) AS BIGINT) AS bytes_seen, count(*) AS observed, CAST(0 AS BIGINT) AS vanished, CAST(0 AS BIGINT) AS unreadable, CAST(0 AS BIGINT) AS backed_up FROM tree
UNION ALL SELECT 2, count(*), CAST(sum(strlen(text)) AS BIGINT), count(*) FILTER (doc_id % 7 = 0), (SELECT count(*) FROM tree WHERE doc_id % 10 = 0), 0, 0 FROM later
UNION ALL SELECT 3, 0, 0, 0, 0, 0, count(DISTINCT text) FROM later
UNION ALL SELECT 4, count(*), CAST(sum(strlen(text)) AS BIGINT), 0, 0, 0, 0 FROM later"""


def _changed(docs: DataFrame, root: str, step: int) -> None:
    """Write the documents as files below the root (step 1), then delete every tenth and lengthen every seventh (step 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for i, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                path = os.path.join(root, source or "none", f"{i}.{'tmp' if i % 13 == 0 else 'txt'}")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                if step == 1:
                    with open(path, "wb") as f:
                        f.write(text.encode())
                elif i % 10 == 0:
                    os.unlink(path)
                elif i % 7 == 0:
                    with open(path, "ab") as f:
                        f.write(b"x")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    docs.where("text is not null").select("doc_id", "source", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()


@_query(TREE_SQL)
def file_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1-3, SRC14, SRC15, FLT15, SNK6, SNK8, T14, T16: documents as a file tree, less what the configuration excludes: a pass, one after
    deletions and changes, the backup of what lives, and a pass in which nothing has changed."""
    place, docs = scratch(spark), table(spark, sf_dir, "documents")
    root = place.removeprefix("file://") + "/files"
    config = Config.parse(Config([root], place + "/store", excludes=["*.tmp"], average_chunk=4096).dump())
    engine, done = Engine(spark, config, key=b"\3" * 32), []
    for step in (1, 2):
        _changed(docs, root, step)
        done.append(engine.run_pass_metadata_only())
    done += [engine.backup_pending(), engine.run_pass()]
    rows = [(k, *astuple(s)[:6]) for k, s in enumerate(done, 1)]
    return spark.createDataFrame(rows, "step int, files_seen long, bytes_seen long, observed long, vanished long, unreadable long, backed_up long")


@_query("SELECT sha256(text) AS content, strlen(text) AS size, sha256(text) AS streamed FROM documents WHERE strlen(text) > 0 GROUP BY text")
def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2: documents that come in blocks of 1,000 bytes, and the hash of their chunks put together, or an error's name where they aren't
    those of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(0).to_pylist():
                got = list(chunking.streamed((data[i : i + 1000] for i in range(0, len(data), 1000)), 256))
                ends = chunking.cuts(data, 256)
                whole = [data[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
                rows.append((hashlib.sha256(data).hexdigest(), sum(map(len, got)), hashlib.sha256(b"".join(got)).hexdigest() if got == whole else "other chunks"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["content", "size", "streamed"])

    docs = table(spark, sf_dir, "documents").where("octet_length(text) > 0").select(F.col("text").cast("binary").alias("data"))
    return docs.mapInArrow(run, "content string, size long, streamed string").groupBy("content").agg(F.max("size").alias("size"), F.max("streamed").alias("streamed"))


#: Fixed values, published test vectors: of Ed25519 (RFC 8032), scrypt (RFC 7914), recovery phrases, SHA-256 (FIPS 180).
ANSWERS = {
    "content_hash": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad",
    "passphrase_key": "7023bdcb3afd7348461c06cd81fd38ebfda8fbba904f8e3ea9b543f6545da1f2",
    "phrase": "0 0 0 0 0 0 0 0 0 0 0 3",
    "phrase_seed": "5eb00bbddcf069084889a8ab9155568165f5c453ccb85e70811aaed6f6da5fc19a5ac40b389cd370d086206dec8aa6c43daea6690f20ad3d8d48b2d2ce9e38e4",
    "phrase_typed": "aabb aaba",
    "public_key": "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a",
    "signature": "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b",
    "signature_holds": "true false",
}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in ANSWERS.items()) + ") AS t(name, answer)")
def known_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN1, FN6, FN14-FN17, LIM1: hashes, keys, phrases and signatures for published inputs."""
    secret = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    words = crypto.WordList(["".join(x) for x in product("abcd", *["abcdefgh"] * 3)])
    own, sig = crypto.public_key(secret), crypto.sign(secret, b"")
    entry = crypto.Entry()
    # eight words begin with aab: the second digit takes one of them, a whole word is entered, opened again and exchanged
    for key in ("a", "a", "b", "2", "a", "a", "b", "c", "enter", "back", "back", "1"):
        entry = crypto.typed(words, 12, entry, key)
    got = {
        "passphrase_key": crypto.Encrypt.from_passphrase("pleaseletmein", b"SodiumChloride").key.hex(),
        "phrase": " ".join(str(words.index[w]) for w in words.encode(bytes(16)).split()),
        "phrase_seed": crypto.mnemonic_seed("abandon " * 11 + "about").hex(),
        "phrase_typed": " ".join(entry.done),
        "public_key": own.hex(),
        "signature": sig.hex(),
        "signature_holds": f"{crypto.verify(own, b'', sig)} {crypto.verify(own, b'x', sig)}".lower(),
    }
    rows = spark.createDataFrame(list(got.items()), "name string, answer string")
    return rows.unionByName(spark.range(1).select(F.lit("content_hash").alias("name"), content_hash(F.lit(b"abc")).alias("answer")))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
