"""The fold: scenarios, order independence, snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhold.operators import inventory, projection
from tallyhold.schemas import LOG

COLUMNS = [c.strip().split()[0] for c in LOG.split(",")]


def log(spark, *events):
    seq = {}
    rows = []
    for e in events:
        m = e.get("machine", "m1")
        seq[m] = seq.get(m, -1) + 1
        rows.append(tuple({"machine": m, "seq": seq[m], **e}.get(c) for c in COLUMNS))
    return spark.createDataFrame(rows, LOG)


def seen(content, path, hlc, **more):
    return {"action": "observed", "content": content, "path": path, "hlc": hlc, "size": len(content), "mtime": 0, **more}


def gone(content, path, hlc, **more):
    return {"action": "vanished", "last_content": content, "path": path, "hlc": hlc, **more}


def backed(content, hlc, **more):
    return {"action": "backed", "content": content, "hlc": hlc, **more}


def contents(p):
    return {r.content: (r["size"], [(x.machine, x.path) for x in r.live_locations], r.backed_up, r.first_seen, r.last_seen) for r in p.contents.collect()}


def test_observed_and_backed(spark):
    assert contents(projection.fold(log(spark, seen("aa", "/a", 5), backed("aa", 6)))) == {"aa": (2, [("m1", "/a")], True, 5, 5)}


def test_tombstone_makes_an_orphan(spark):
    p = projection.fold(log(spark, seen("aa", "/a", 5), backed("aa", 6), gone("aa", "/a", 7)))
    assert contents(p)["aa"] == (2, [], True, 5, 5)
    assert inventory.orphans(p.contents).count() == 1 and inventory.duplicates(p.contents).count() == 0


def test_a_newer_content_takes_the_place(spark):
    assert {k: v[1] for k, v in contents(projection.fold(log(spark, seen("aa", "/a", 5), seen("b", "/a", 6)))).items()} == {"aa": [], "b": [("m1", "/a")]}


def test_a_late_older_event_loses_but_counts_as_seen(spark):
    p = projection.fold(log(spark, gone("aa", "/a", 9), seen("aa", "/a", 5)))
    assert p.locations.first().state == "tombstoned" and contents(p)["aa"] == (2, [], False, 5, 5)


def test_backed_alone_is_an_orphan_without_size(spark):
    assert contents(projection.fold(log(spark, backed("aa", 1)))) == {"aa": (0, [], True, 0, 0)}


def test_history_has_live_and_tombstoned_places(spark):
    p = projection.fold(log(spark, seen("aa", "/a", 1), seen("aa", "/b", 2), gone("aa", "/b", 3)))
    assert sorted((r.path, r.state) for r in inventory.history(p.locations, "aa").collect()) == [("/a", "live"), ("/b", "tombstoned")]


def test_deleting_on_one_machine_leaves_the_other(spark):
    p = projection.fold(log(spark, seen("aa", "/a", 1), seen("aa", "/a", 2, machine="m2"), gone("aa", "/a", 3)))
    assert contents(p)["aa"][1] == [("m2", "/a")]


def test_equal_clocks_go_to_the_higher_number(spark):
    assert contents(projection.fold(log(spark, seen("aa", "/a", 5), seen("b", "/a", 5))))["b"][1] == [("m1", "/a")]


def _random(spark, n=240):
    r, events, clock = random.Random(2), [], 0
    for _ in range(n):
        clock += r.randint(1, 3)
        c, p, m = f"c{r.randint(0, 9)}", f"/p{r.randint(0, 7)}", f"m{r.randint(0, 2)}"
        events.append(r.choice([seen(c, p, clock, machine=m), seen(c, p, clock, machine=m), gone(c, p, clock, machine=m), backed(c, clock, machine=m), {"action": "pass_completed", "root": "/", "files_seen": clock, "bytes_seen": 1, "hlc": clock, "machine": m}]))
    return log(spark, *events)


def test_any_order_gives_the_same_state(spark):
    events = _random(spark)
    want = projection.state_hash(projection.fold(events)).first()
    for seed in (1, 2):
        mixed = events.orderBy(F.rand(seed)).repartition(3)
        assert projection.state_hash(projection.fold(mixed)).first() == want


def test_snapshot_and_the_rest_is_the_whole(spark):
    events = _random(spark)
    early, late = events.where("hlc < 200"), events.where("hlc >= 150")
    both, whole = projection.fold(late, projection.fold(early)), projection.fold(events)
    for name, df in whole.tables().items():
        other = both.tables()[name].select(*df.columns)
        if name == "tips":
            df, other = df.drop("hash"), other.drop("hash")
        assert df.exceptAll(other).isEmpty() and other.exceptAll(df).isEmpty(), name


def test_latest_pass_and_snapshot(spark):
    events = log(spark, {"action": "pass_completed", "root": "/", "files_seen": 1, "bytes_seen": 1, "hlc": 1}, {"action": "pass_completed", "root": "/", "files_seen": 2, "bytes_seen": 9, "hlc": 2}, {"action": "snapshot", "state_hash": "x", "hlc": 3}, {"action": "snapshot", "state_hash": "y", "hlc": 4})
    assert projection.pass_stats(events).first().asDict() == {"root": "/", "files_seen": 2, "bytes_seen": 9, "last_pass_hlc": 2}
    assert projection.last_snapshot(events).first().state_hash == "y"


@pytest.mark.parametrize(("keep", "want"), [(5, ["old"]), (0, ["old", "new"]), (10, [])])
def test_retention_takes_old_orphans_oldest_first(spark, keep, want):
    s = 10**9
    events = log(spark, seen("old", "/o", 1), backed("old", 2), gone("old", "/o", s), seen("new", "/n", 3), backed("new", 4), gone("new", "/n", 8 * s), seen("live", "/l", 5), backed("live", 6), seen("over", "/x", 7), backed("over", 8), seen("it", "/x", 9))
    p = projection.fold(events)
    assert [r.content for r in inventory.retention(p.contents, p.locations, 10 * s, keep).collect()] == want


def test_resolution_and_work_list(spark):
    a = "ab" * 32
    p = projection.fold(log(spark, seen(a, "/a", 1), seen("cc", "/c", 2), backed("cc", 3), seen(a, "/0", 4, machine="m2")))
    targets = spark.createDataFrame([(a.upper(),), ("/c",), ("/none",)], "target string")
    got = {r.target: r.content for r in inventory.resolve(projection.path_to_content(p.locations, by_machine=False), targets).collect()}
    assert got == {a.upper(): a, "/c": "cc", "/none": None}
    assert [tuple(r) for r in inventory.backup_worklist(p.facts, p.locations, "m1").collect()] == [(a, 64, "/a")]


def test_segments_to_take_and_to_drop(spark):
    segments = spark.createDataFrame([("a", 0, 0), ("a", 1, 5), ("b", 0, 3)], "machine string, seq_start long, seq_end long")
    none = spark.createDataFrame([("a", 0)], "machine string, last_seq long")
    assert sorted((r.machine, r.seq_start) for r in inventory.new_segments(segments, none).collect()) == [("a", 1), ("b", 0)]
    tips = spark.createDataFrame([("a", 3)], "machine string, seq long")
    assert sorted((r.machine, r.seq_start) for r in inventory.unneeded_dropped(segments, tips).collect()) == [("a", 1), ("b", 0)]
