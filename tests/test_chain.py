"""Chains: links, and what verification finds in tampered segments."""

import pytest
from pyspark.sql import functions as F

from tallyhold.errors import ChainError, SegmentOwnerError
from tallyhold.functions.crypto import public_key
from tallyhold.operators import chain
from tallyhold.schemas import LOG, ZERO_HASH

KEY, OTHER = b"\x01" * 32, b"\x02" * 32
ME = public_key(KEY).hex()


@pytest.fixture(scope="module")
def entries(spark):
    names = [c.strip().split()[0] for c in LOG.split(",")]
    rows = [tuple({"machine": ME, "seq": i, "hlc": 10 + i, "action": "backed", "content": f"c{i}"}.get(c) for c in names) for i in range(4)]
    found = chain.linked(spark.createDataFrame(rows, LOG), None, {ME: KEY}).collect()
    return spark.createDataFrame([tuple(r[c] for c in names) for r in found], LOG)


def fault(entries, tips=None, signatures=False, **head):
    rows = entries.withColumns({"segment": F.lit("s"), "ord": F.col("seq")})
    spark = entries.sparkSession
    last = entries.orderBy(F.desc("seq")).first()
    values = {"seq_start": 0, "seq_end": 3, "tip_hash": last.hash if last else "", **head}
    headers = spark.createDataFrame([("s", ME, values["seq_start"], values["seq_end"], values["tip_hash"])], "segment string, owner string, seq_start long, seq_end long, tip_hash string")
    r = chain.verify(rows, headers, tips, signatures=signatures).first()
    return r.error, r.error_seq


def at(column, seq, value):
    return F.when(F.col("seq") == seq, value).otherwise(F.col(column))


def test_a_chain_links_and_verifies(entries):
    rows = entries.orderBy("seq").collect()
    assert rows[0].prev == ZERO_HASH and [r.prev for r in rows[1:]] == [r.hash for r in rows[:-1]]
    assert fault(entries, signatures=True) == (None, None)


def test_no_entries(entries):
    assert fault(entries.where("false")) == ("empty_segment", None)


def test_headers(entries):
    assert fault(entries, seq_start=1)[0] == "first_not_start"
    assert fault(entries, seq_end=4)[0] == "last_not_end"
    assert fault(entries, tip_hash="x")[0] == "tip_mismatch"


def test_known_tips(spark, entries):
    tips = spark.createDataFrame([(ME, "f" * 64)], "machine string, hash string")
    assert fault(entries, tips) == ("restarted", None)
    late = entries.where("seq >= 2")
    assert fault(late, tips, seq_start=2)[0] == "broken_from_tip"
    assert fault(late, seq_start=2)[0] == "unknown_start"
    right = spark.createDataFrame([(ME, entries.where("seq = 1").first().hash)], "machine string, hash string")
    assert fault(late, right, seq_start=2) == (None, None)
    assert fault(entries.withColumn("prev", at("prev", 0, F.lit("1" * 64))))[0] == "not_genesis"


@pytest.mark.parametrize(
    ("change", "want"),
    [
        (lambda d: d.where("seq <> 1"), ("non_contiguous", 2)),
        (lambda d: d.withColumn("content", at("content", 1, F.lit("x"))), ("invalid_hash", 1)),
        (lambda d: d.withColumn("prev", at("prev", 2, F.lit("0" * 64))), ("broken_chain", 2)),
        (lambda d: d.withColumn("machine", at("machine", 3, F.lit("m"))), ("machine_mismatch", 3)),
        (lambda d: d.withColumn("content", at("content", 1, F.lit("x"))).withColumn("machine", at("machine", 3, F.lit("m"))), ("invalid_hash", 1)),
    ],
)
def test_tampering(entries, change, want):
    assert fault(change(entries)) == want


def test_signatures(entries):
    assert fault(entries.withColumn("sig", at("sig", 2, F.lit("00" * 64))), signatures=True) == ("invalid_signature", 2)
    assert fault(entries.withColumn("sig", at("sig", 2, F.lit(None))), signatures=True) == ("invalid_signature", 2)


def test_a_wrong_signer(spark, entries):
    wrong = chain.linked(entries, None, {ME: OTHER})
    assert fault(wrong, signatures=True) == ("invalid_signature", 0)


def test_check_counts_up_to_the_first_fault(spark):
    found = spark.createDataFrame([("a", "o", 0, None, None), ("b", "o", 4, "invalid_hash", 5), ("c", "o", 8, None, None)], "segment string, owner string, seq_start long, error string, error_seq long")
    counts = spark.createDataFrame([("a", 4), ("b", 4), ("c", 4)], "segment string, n long")
    assert tuple(chain.check_own(found, counts).first()) == ("o", 4, "invalid_hash")


def test_what_can_be_a_segment(spark, entries):
    assert chain.one_segment(entries, ME) is entries
    for rows, kind in ((entries.where("false"), "empty_segment"), (entries.where("seq <> 1"), "non_contiguous"), (entries.withColumn("machine", at("machine", 1, F.lit("zz"))), "machine_mismatch")):
        with pytest.raises(ChainError) as e:
            chain.one_segment(rows)
        assert e.value.kind == kind
    with pytest.raises(SegmentOwnerError):
        chain.one_segment(entries, "another")


def test_gaps_and_clock(entries):
    assert [tuple(r) for r in chain.gaps(entries.where("seq <> 1")).collect()] == [(ME, 2, 0)]
    assert chain.clock_faults(entries).isEmpty()
    assert [r.seq for r in chain.clock_faults(entries.withColumn("hlc", at("hlc", 2, F.lit(11)))).collect()] == [2]
