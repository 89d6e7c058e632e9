"""Whole passes, stores shared by machines, streams and the command line."""

import hashlib
import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from tallyhold import cli
from tallyhold.errors import ChainError, ConfigError, IntegrityError, NotFoundError, SegmentOwnerError
from tallyhold.functions.crypto import Encrypt
from tallyhold.operators import inventory, projection
from tallyhold.plans.engine import Engine
from tallyhold.sources.config import Config
from tallyhold.sources.store import Store
from tallyhold.streaming import fold


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture
def place(tmp_path):
    (tmp_path / "files").mkdir()
    return tmp_path


def engine(spark, place, key=b"\x01", transform=None, store="store", **more):
    return Engine(spark, Config([str(place / "files")], f"file://{place}/{store}", average_chunk=4096, **more), transform=transform, key=key * 32)


def test_passes(spark, place):
    root = place / "files"
    (root / "a").write_bytes(b"same")
    (root / "b").write_bytes(b"same")
    (root / "c").write_bytes(random.Random(1).randbytes(50_000))
    own = engine(spark, place)
    first = own.run_pass()
    assert (first.files_seen, first.observed, first.vanished, first.backed_up) == (3, 3, 0, 2) and first.chunks_uploaded == first.chunks_total > 4
    assert inventory.duplicates(own.projection().contents).first().content == sha(b"same")
    again = engine(spark, place).run_pass()
    assert (again.files_seen, again.observed, again.vanished, again.backed_up, again.chunks_total) == (3, 0, 0, 0, 0)
    (root / "a").unlink()
    (root / "d").write_bytes(b"new")
    (root / "b").write_bytes(b"changed!")
    third = own.run_pass()
    assert (third.observed, third.vanished, third.backed_up) == (2, 1, 2)
    out = place / "out"
    own.restore(sha(b"same"), str(out))
    assert out.read_bytes() == b"same" and (root / "d").read_bytes() == b"new"
    assert tuple(own.check().first())[1:] == (own.log().count(), None)
    s = own.status().first()
    assert (s.contents, s.locations, s.duplicates, s.orphans) == (4, 3, 0, 1)
    gone = own.candidates(0, now=time.time_ns() + 10**12)
    assert [r.content for r in gone.collect()] == [sha(b"same")]
    chunks = own.store.chunk_ids().count()
    own.collect_garbage(gone)
    with pytest.raises(NotFoundError):
        own.restore(sha(b"same"), str(out))
    assert own.store.chunk_ids().count() == chunks


def test_metadata_first_and_backup_later(spark, place):
    (place / "files/empty").write_bytes(b"")
    (place / "files/x").write_bytes(b"x" * 9000)
    own = engine(spark, place, transform=Encrypt(bytes(range(32))))
    assert own.run_pass_metadata_only().backed_up == 0 and own.store.chunk_ids().isEmpty()
    assert own.backup_pending().backed_up == 2 and own.backup_pending().backed_up == 0
    for data in (b"", b"x" * 9000):
        own.restore(sha(data), str(place / "out"))
        assert (place / "out").read_bytes() == data
    with pytest.raises(IntegrityError):
        engine(spark, place, transform=Encrypt(bytes(32))).restore(sha(b"x" * 9000), str(place / "bad"))
    assert not (place / "bad").exists()


def test_machines_share_a_store(spark, place):
    (place / "files/x").write_bytes(random.Random(2).randbytes(30_000))
    one, two = engine(spark, place), engine(spark, place, b"\x02")
    one.run_pass()
    assert two.run_pass_metadata_only().observed == 1
    assert two.backup_pending().backed_up == 0  # the first has backed it up
    assert [r.machine for r in one.store.machines().collect()] == sorted([one.machine, two.machine])
    got = two.pull()
    assert got.select("machine").distinct().collect() == [(one.machine,)] and two.clock.current >= one.clock.current - 10
    tips = projection.chain_tips(got).select("machine", F.col("seq").alias("last_seq"), "hash")
    tips = spark.createDataFrame(tips.collect(), tips.schema)
    assert two.pull(tips).isEmpty()
    (place / "files/y").write_bytes(b"y")
    one.run_pass()
    assert two.pull(tips).count() == 3
    with pytest.raises(ChainError):
        two.pull(tips.withColumn("hash", F.lit("0" * 64)))
    # what the pulls before have taken is known without being told
    assert two.pull().isEmpty() and engine(spark, place, b"\x02").pull().isEmpty()
    (place / "files/z").write_bytes(b"z")
    one.run_pass()
    assert two.pull().select("path").where("path is not null").collect() == [(str(place / "files/z"),)]
    with pytest.raises(SegmentOwnerError):
        two.store.push(got, two.machine)
    assert one.check(all_machines=True).where("first_error is not null").isEmpty()


def rewritten(spark, place, change):
    """The log with its rows changed, in place."""
    path = place / "store/log"
    log = spark.read.parquet(f"file://{path}")
    rows = spark.createDataFrame(change(log).collect(), log.schema)
    shutil.rmtree(path)
    rows.write.partitionBy("machine").parquet(f"file://{path}")


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (lambda log: log.where(F.col("seq") < F.col("seq_end") - 1), "last_not_end"),
        (lambda log: log.withColumn("tip_hash", F.lit("0" * 64)), "tip_mismatch"),
        (lambda log: log.where(F.col("seq") > F.col("seq_start")), "first_not_start"),
        (lambda log: log.withColumn("hlc", F.col("hlc") + F.when(F.col("seq") == 1, 1).otherwise(0)), "invalid_hash"),
        (lambda log: log.withColumn("sig", F.reverse("sig")), "invalid_signature"),
    ],
)
def test_tampering_is_found(spark, place, change, error):
    for name in "abc":
        (place / "files" / name).write_bytes(name.encode())
    own = engine(spark, place)
    own.run_pass_metadata_only()
    assert own.check().first().first_error is None
    rewritten(spark, place, change)
    assert own.check().first().first_error == error
    with pytest.raises(ChainError, match=error):
        engine(spark, place, b"\x02").pull()


def test_a_pass_that_dies_between_log_and_catalog_is_taken_up(spark, place, monkeypatch):
    for name in "ab":
        (place / "files" / name).write_bytes(name.encode())
    own = engine(spark, place)
    monkeypatch.setattr(own.store, "replace", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        own.run_pass()
    again = engine(spark, place)
    second = again.run_pass()
    assert (second.observed, second.vanished, second.backed_up) == (2, 0, 2)
    assert tuple(again.check().first())[1:] == (again.log().count(), None)
    assert again.status().first().locations == 2 and again.run_pass().observed == 0


def test_the_projection_goes_on_from_a_snapshot(spark, place, monkeypatch):
    (place / "files/x").write_bytes(b"x")
    own = engine(spark, place)
    own.run_pass()
    own.snapshot()
    (place / "files/y").write_bytes(b"y")
    own.run_pass()
    whole = projection.fold(own.log())
    seen = []
    fold_of = projection.fold
    monkeypatch.setattr(projection, "fold", lambda log, onto=None: seen.append((log.count(), onto is not None)) or fold_of(log, onto))
    got = own.projection()
    assert seen == [(4, True)] and projection.state_hash(got).first() == projection.state_hash(whole).first()
    for of in ("locations", "passes", "tips"):
        assert sorted(map(tuple, getattr(got, of).collect())) == sorted(map(tuple, getattr(whole, of).collect()))


def test_configuration(tmp_path, monkeypatch):
    text = f"""roots = ["/a"]
excludes = ["*.tmp"]
[remote]
kind = "s3"
bucket = "b"
prefix = "p"
endpoint = "http://e"
access_key_id_env = "OWN_ID"
secret_access_key_env = "OWN_SECRET"
[encryption]
enabled = true
salt_path = "{tmp_path}/deep/salt"
[scan]
follow_symlinks = true
"""
    config = Config.parse(text)
    assert Config.parse(config.dump()) == config and config.store == "s3a://b/p" and config.scan_options == {"follow_symlinks": "true"}
    config.write(str(tmp_path / "c.toml"))
    assert Config.load(str(tmp_path / "c.toml")) == config
    with pytest.raises(ConfigError, match="OWN_ID"):
        config.secrets()
    monkeypatch.setenv("OWN_ID", "i")
    monkeypatch.setenv("OWN_SECRET", "s")
    assert config.secrets() == {"fs.s3a.access.key": "i", "fs.s3a.secret.key": "s"}
    salt = config.salt()
    assert len(salt) == 16 and config.salt() == salt
    (tmp_path / "deep/salt").write_bytes(b"short")
    with pytest.raises(ConfigError):
        config.salt()
    local = Config(["/a"], "file:///s", retain_seconds=5)
    assert Config.parse(local.dump()) == local


def test_store(spark, place):
    store = Store(spark, f"file://{place}/s")
    rows = spark.createDataFrame([(sha(b"a"), bytearray(b"a")), (sha(b"b"), bytearray(b"b"))], "chunk_id string, data binary")
    for _ in range(2):
        store.put_chunks(rows)
    assert store.chunk_ids().count() == 2 and store.has(rows.union(spark.createDataFrame([("z", None)], rows.schema))).count() == 2
    assert bytes(store.verified(rows.where(F.col("chunk_id") == sha(b"a"))).first().data) == b"a"
    store.put_chunks(spark.createDataFrame([("f" * 64, bytearray(b"zz"))], rows.schema))
    with pytest.raises(Exception, match="corrupt"):
        store.verified(spark.createDataFrame([("f" * 64,)], "chunk_id string")).collect()
    store.delete_chunk("f" * 64)
    with pytest.raises(NotFoundError):
        store.delete_chunk("f" * 64)
    assert store.chunk_ids().count() == 2
    store.put_chunks(spark.createDataFrame([("f" * 64, bytearray(b"again"))], rows.schema))
    assert bytes(store.chunks().where(F.col("chunk_id") == "f" * 64).first().data) == b"again"
    with pytest.raises(NotFoundError):
        store.manifest("0" * 64)
    with pytest.raises(NotFoundError):
        store.delete_manifests(spark.createDataFrame([("q",)], "content string"), missing_ok=False)
    for n in (1, 2, 3, 4):
        store.replace("t", {"x": spark.range(n)})
        assert store.current("t", "x").count() == n
    # the current version, the one before it, and the pointer
    assert len([x for x in store.names("t") if not x.startswith(".")]) == 3


def test_snapshot(spark, place):
    (place / "files/x").write_bytes(b"x")
    own = engine(spark, place)
    own.run_pass()
    value = own.snapshot()
    back = own.store.snapshot(value)
    assert projection.state_hash(back).first().state_hash == value
    assert projection.last_snapshot(own.log()).first().state_hash == value
    (place / "files/y").write_bytes(b"y")
    own.run_pass()
    late = inventory.unneeded_dropped(own.store.segments(), back.tips)
    rest = own.log().join(late.select("machine", "seq_start"), ["machine", "seq_start"], "left_semi")
    assert projection.state_hash(projection.fold(rest, back)).first() == projection.state_hash(own.projection()).first()


def test_streamed_fold_is_the_batch_fold(spark, place):
    (place / "files/x").write_bytes(b"x")
    own = engine(spark, place)
    own.run_pass()
    (place / "files/x").write_bytes(b"xx")
    (place / "files/y").write_bytes(b"y")
    own.run_pass()
    uri, want = own.store.uri, own.projection()
    assert fold.folded(own.store) is None
    q = fold.keep_folded(fold.log_stream(spark, uri, files_per_batch=1), own.store, f"file://{place}/cp1", compact_after=2)
    assert q.awaitTermination(300)
    # two batches have become the base, others are by themselves
    assert own.store.current("projection", "upto").first().number % 2 == 1
    for _ in range(2):
        got = fold.folded(own.store)
        assert projection.state_hash(got).first() == projection.state_hash(want).first()
        assert sorted(map(tuple, got.tips.collect())) == sorted(map(tuple, want.tips.collect()))
        fold.compact(own.store)
    assert own.store.names("projection-batches") == []
    live = fold.live_locations(fold.log_stream(spark, uri))
    q = live.writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", f"file://{place}/cp2").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("live").select("path", "state", "content").collect())) == sorted(map(tuple, want.locations.select("path", "state", "content").collect()))
    assert fold.windowed_activity(own.log()).agg(F.sum("events")).first()[0] == own.log().count()


def test_command_line(spark, place, capsys):
    (place / "files/a").write_bytes(b"same")
    (place / "files/b").write_bytes(b"same")
    config = place / "c.toml"
    config.write_text(f'roots = ["{place}/files"]\n[remote]\npath = "file://{place}/store"\n[machine]\nkey_file = "{place}/key"\n')

    def run(*args):
        code = cli.main(["--config", str(config), *args], spark)
        got = capsys.readouterr()
        return code, got.out + got.err

    assert "2 observed" in run("scan")[1]
    assert "duplicates: 1" in run("status")[1]
    assert sha(b"same") in run("dupes")[1] and run("orphans") == (0, "")
    assert run("locate", f"{place}/files/a")[1].count("live") == 2
    assert run("restore", sha(b"same").upper(), "--out", str(place / "o"))[0] == 0 and (place / "o").read_bytes() == b"same"
    assert run("check")[0] == 0
    assert run("gc")[0] == 1 and run("gc", "--retain-after-secs", "0") == (0, "")
    os.unlink(place / "files/a")
    os.unlink(place / "files/b")
    run("scan")
    assert sha(b"same") in run("orphans")[1] and sha(b"same") in run("gc", "--retain-after-secs", "0")[1]
    assert "1 manifests deleted" in run("gc", "--retain-after-secs", "0", "--confirm")[1]
    assert run("locate", "/nowhere")[0] == 1
    with pytest.raises(ConfigError):
        Engine(spark, Config([], "file:///x"))


def test_shuffle_files_are_freed_by_passes_only(spark, place, monkeypatch):
    """the setting holds while a pass scans and stores, and is as before when it ends, well or not."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen, stage = spark.conf.get(key, None), [], Store.stage
    monkeypatch.setattr(Store, "stage", lambda self, name, df: seen.append(spark.conf.get(key)) or stage(self, name, df))
    (place / "files" / "a").write_bytes(b"a")
    assert engine(spark, place).run_pass_metadata_only().observed == 1
    assert seen and set(seen) == {"true"} and spark.conf.get(key, None) == before
    monkeypatch.setattr(Store, "stage", lambda self, name, df: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        engine(spark, place).run_pass_metadata_only()
    assert spark.conf.get(key, None) == before
