"""Walks, differences, chunks and restores."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyhold.errors import ConfigError, ScanError
from tallyhold.functions.crypto import Encrypt
from tallyhold.operators import chunking, scan
from tallyhold.schemas import CATALOG
from tallyhold.sources import files
from tallyhold.sources.config import Config


def put(root, tree):
    for name, data in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def names(root, df):
    return sorted(os.path.relpath(r.path, root) for r in df.where("error is null").collect())


def test_walk(spark, tmp_path):
    put(tmp_path, {"a": b"1", ".hidden": b"", "d/b": b"22", "d/.deep/c": b"3", "node_modules/x/y": b"4", "d/skip.log": b"5", "build/out": b"6", "d/keep.log": b"7", ".gitignore": b"*.log\nbuild/\n!keep.log\n"})
    os.symlink("/etc/hostname", tmp_path / "link")
    os.link(tmp_path / "a", tmp_path / "hard")
    got = files.walk(spark, str(tmp_path), excludes="node_modules/**")
    assert names(tmp_path, got) == [".gitignore", ".hidden", "a", "d/.deep/c", "d/b", "d/keep.log", "hard"]
    ids = {os.path.basename(r.path): (r["size"], r.mtime, r.file_id) for r in got.collect()}
    assert ids["a"] == ids["hard"] and ids["a"][1] == (tmp_path / "a").stat().st_mtime_ns and ids[".hidden"][0] == 0
    assert "d/skip.log" in names(tmp_path, files.walk(spark, str(tmp_path), respect_gitignore="false"))
    with pytest.raises(Exception, match="none"):
        files.walk(spark, str(tmp_path / "none")).collect()
    assert ScanError


def test_rules_of_a_repository_and_of_folders_above(spark, tmp_path):
    put(tmp_path, {"repo/.git/info/exclude": b"own.txt\n", "repo/.gitignore": b"*.log\n/root/deep/x\n", "repo/root/a.log": b"", "repo/root/b": b"", "repo/root/own.txt": b"", "repo/root/deep/x": b"", "repo/root/deep/y": b"", "repo/root/deep/.ignore": b"z*\n", "repo/root/deep/er/zz": b"", ".ignore": b"b\n"})
    root = tmp_path / "repo/root"
    assert names(root, files.walk(spark, str(root))) == ["b", "deep/.ignore", "deep/y"]
    # outside a repository nothing above the root counts
    put(tmp_path, {"plain/root/c.log": b"", "plain/.gitignore": b"*.log\n"})
    assert names(tmp_path / "plain/root", files.walk(spark, str(tmp_path / "plain/root"))) == ["c.log"]


def test_a_walk_is_split_below_the_root(spark, tmp_path):
    tree = {f"one/{a}/{b}/f{c}": b"" for a in range(5) for b in range(20) for c in range(2)} | {"one/top": b"", "skip/x": b"", ".gitignore": b"skip/\n"}
    put(tmp_path, tree)
    os.symlink(tmp_path, tmp_path / "one/0/loop")
    parts = files.FileTreeReader({"path": str(tmp_path)}).partitions()
    assert sum(p.deep for p in parts) == 100 and not any("skip" in p.path for p in parts)
    assert names(tmp_path, files.walk(spark, str(tmp_path))) == sorted(x for x in tree if x != "skip/x")
    followed = files.walk(spark, str(tmp_path), follow_symlinks="true")
    assert names(tmp_path, followed) == sorted(x for x in tree if x != "skip/x")


@pytest.mark.parametrize("size", [1, 100, 5000, 100_000])
def test_a_stream_is_cut_as_the_whole_is(size):
    for data in (b"", random.Random(1).randbytes(40_000), bytes(30_000), b"ab" * 9000):
        ends = chunking.cuts(data, 256)
        assert list(chunking.streamed((data[i : i + size] for i in range(0, len(data), size)), 256)) == [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else True


def test_hashes(spark, tmp_path):
    put(tmp_path, {"a": b"x" * 200_000, "b": b""})
    df = spark.createDataFrame([(str(tmp_path / n),) for n in ("a", "b", "gone")], "path string")
    got = {os.path.basename(r.path): (r.content, r.error is None) for r in files.hashed(df).collect()}
    assert got == {"a": (hashlib.sha256(b"x" * 200_000).hexdigest(), True), "b": (hashlib.sha256(b"").hexdigest(), True), "gone": (None, False)}


def test_classification(spark):
    catalog = spark.createDataFrame([("/same", "c1", 1, 1, 5, 0), ("/ids", "c2", 1, 1, 0, 0), ("/touched", "c3", 1, 1, 7, 0), ("/other", "c4", 1, 1, 8, 0), ("/gone", "c5", 1, 1, 9, 0), ("/locked/in", "c6", 1, 1, 10, 0)], CATALOG)
    walk = spark.createDataFrame([("/same", 1, 1, 5, None), ("/ids", 1, 1, 6, None), ("/touched", 1, 2, 7, None), ("/other", 1, 1, 88, None), ("/new", 4, 4, 0, None), ("/locked", None, None, None, "denied")], "path string, size long, mtime long, file_id long, error string")
    got = {r.path: r.status for r in scan.classify(walk, catalog).collect()}
    assert got == {"/same": "unchanged", "/ids": "unchanged", "/touched": "changed", "/other": "changed", "/gone": "vanished", "/new": "new", "/locked": "unreadable", "/locked/in": "unreadable"}


def test_hard_links_are_read_once_and_both_seen(spark):
    walk = spark.createDataFrame([("/a", 1, 1, 5, None), ("/b", 1, 1, 5, None), ("/c", 1, 1, 0, None), ("/d", 1, 1, 0, None)], "path string, size long, mtime long, file_id long, error string")
    found = scan.classify(walk, spark.createDataFrame([], CATALOG))
    todo = scan.to_hash(found)
    assert sorted(r.path for r in todo.collect()) == ["/a", "/c", "/d"]
    events = scan.events(found, todo.withColumn("content", F.concat(F.lit("h"), "path")), "/")
    assert sorted((r.path, r.content) for r in events.where("action = 'observed'").collect()) == [("/a", "h/a"), ("/b", "h/a"), ("/c", "h/c"), ("/d", "h/d")]
    assert events.where("action = 'pass_completed'").first().asDict()["files_seen"] == 4


@pytest.mark.parametrize("size", [0, 1, 63, 64, 255, 1024, 70_000, 1_000_000])
def test_cuts_are_bounded_and_cover(size):
    data = random.Random(size).randbytes(size)
    ends = chunking.cuts(data, 4096)
    widths = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert sum(widths) == size and all(w <= 4 * 4096 for w in widths) and all(w >= 1024 for w in widths[:-1])
    assert ends == chunking.cuts(data, 4096)


def test_rolling_hash_is_that_of_a_byte_loop():
    data, h, want = random.Random(1).randbytes(300), 0, []
    for i, b in enumerate(data):
        h = (h << 1) + int(chunking.GEAR[b])
        want.append(sum(int(chunking.GEAR[data[i - k]]) << k for k in range(min(64, i + 1))) % 2**64)
    import numpy as np

    assert chunking._gear_hashes(np.frombuffer(data, np.uint8)).tolist() == want


def test_most_chunks_survive_a_byte_before_them():
    data = random.Random(3).randbytes(2_000_000)

    def ids(d):
        ends = chunking.cuts(d, 65_536)
        return [hashlib.sha256(d[a:b]).hexdigest() for a, b in zip([0, *ends], ends, strict=False)]

    before, after = ids(data), ids(b"!" + data)
    assert len(set(before) & set(after)) > len(before) / 2


def test_equal_beginnings_share_chunks(spark):
    base = random.Random(4).randbytes(400_000)
    rows = [(str(i), bytearray(base + random.Random(i + 10).randbytes(1000))) for i in range(8)]
    got = chunking.stored(chunking.chunks(spark.createDataFrame(rows, "content string, data binary"), 16_384))
    assert got.select("chunk_id").distinct().count() * 3 < got.count()


def test_small_averages_are_refused(spark):
    with pytest.raises(ConfigError):
        chunking.cuts(b"x", 100)
    with pytest.raises(ConfigError):
        chunking.chunks(spark.createDataFrame([], "content string, data binary"), 255)


@pytest.fixture(scope="module")
def kept(spark):
    rows = [(hashlib.sha256(d).hexdigest(), bytearray(d)) for d in (random.Random(n).randbytes(n) for n in (1, 1024, 65_536, 300_000))]
    contents = spark.createDataFrame(rows, "content string, data binary")
    own = Encrypt(bytes(range(32)))
    cut = chunking.stored(chunking.chunks(contents, 4096), own).persist()
    return dict(rows), own, chunking.refs(cut, 1), cut.select("chunk_id", "data").dropDuplicates(["chunk_id"])


def test_round_trip(kept):
    rows, own, refs, store = kept
    got = chunking.restored(refs, store, own).collect()
    assert {r.content: bytes(r.data) for r in got} == {k: bytes(v) for k, v in rows.items()} and all(r.error is None for r in got)


def test_damage_is_found_and_nothing_given(kept):
    rows, own, refs, store = kept
    last = refs.orderBy(F.desc("total_size"), "ordinal").first()

    def only(refs, store, how=own):
        r = chunking.restored(refs.where(F.col("content") == last.content), store, how).first()
        return r.data, r.error

    hit = F.col("chunk_id") == last.chunk_id
    assert only(refs, store.where(~hit)) == (None, "missing")
    assert only(refs, store.withColumn("data", F.when(hit, F.concat("data", F.lit(b"x"))).otherwise(F.col("data")))) == (None, "corrupt")
    assert only(refs, store, Encrypt(bytes(32))) == (None, "undecipherable")
    assert only(refs.withColumn("total_size", F.col("total_size") + 1), store) == (None, "length")
    swapped = refs.withColumns({"content": F.lit("0" * 64)}).where("total_size = 1")
    assert chunking.restored(swapped, store, own).first().error == "hash"
    assert only(refs.withColumn("version", F.lit(99)), store) == (None, "version")


def test_configuration(tmp_path):
    c = Config.parse('roots = ["/a"]\nexcludes = ["*.o"]\n[remote]\nkind = "local"\npath = "file:///s"\n[chunking]\naverage = 4096\n[retention]\nretain_after_secs = 5\n[machine]\nkey_file = "k"\n')
    assert (c.roots, c.store, c.average_chunk, c.retain_seconds, c.key_file, c.encryption) == (["/a"], "file:///s", 4096, 5, "k", False)
    r2 = Config.parse('roots = []\n[remote]\nkind = "r2"\nbucket = "b"\nendpoint = "https://e"\n')
    assert r2.store == "s3a://b" and r2.store_options["fs.s3a.endpoint.region"] == "auto" and r2.average_chunk == chunking.DEFAULT_AVERAGE
    for bad in ("roots = [", "roots = []", 'roots = []\n[remote]\nkind = "x"', 'roots = []\n[remote]\npath = "p"\n[chunking]\naverage = 1'):
        with pytest.raises(ConfigError):
            Config.parse(bad)
