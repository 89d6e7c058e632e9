"""Each stage of the pipeline against a plain version, over a table with copies, repeats, leaks and odd texts."""

import brute
import pytest
from conftest import make, odd_rows

import corpus_pipeline
from tallyhold.llm.common import staged


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rows = odd_rows()
    leak = dict(rows)[25]
    rows.append((200, "so it begins. " + leak + " and so it ends."))
    make(spark, rows, f"{root}/documents.parquet")
    spark.createDataFrame([(1, " ".join(leak.split()[:30]) if len(leak.split()) > 12 else leak), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    bad = [(300 + k, "stupid idiot moron " * 3 + f"w{k} x{k} y{k}") for k in range(40)]
    fine = [(400 + k, f"kind gentle warm {k} tea soup") for k in range(200)]
    docs = rows + bad + fine
    make(spark, docs, f"{root}/docs2/documents.parquet")
    spark.createDataFrame([(i, 1) for i, _ in bad] + [(i, 0) for i in {i for i, _ in fine + rows}], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), docs


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, place):
    root, rows = place
    docs = spark.read.parquet(f"{root}/docs2/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "suffix_dedup", "decontamination", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    kept = staged(stage["toxicity"](spark, docs, root), "t1")
    assert kept.schema == docs.schema
    assert {i for i, _ in texts(kept)} == {i for i, _ in rows if not 300 <= i < 340}

    before = texts(kept)
    unique = staged(stage["near_copies"](spark, kept, root), "t2")
    assert unique.schema == docs.schema
    by_id = sorted(brute.op7(before))
    # rows of one id are equal here: one of them stays, and all of those without words
    want = {i for i, _, c in by_id if c == i}
    assert {i for i, _ in texts(unique)} == want and sum(i == 8 for i, _ in texts(unique)) <= 1 and sum(i == 17 for i, _ in texts(unique)) == 2

    before = texts(unique)
    cut = staged(stage["suffix_dedup"](spark, unique, root), "t3")
    assert cut.columns == docs.columns
    assert texts(cut) == sorted(((i, None if t is None else kept_text(before, k)) for k, (i, t) in enumerate(before)), key=str)
    assert all(r.text is None or r.n_chars == len(r.text) for r in cut.collect())
    assert {r.uid for r in cut.collect()} == {"u"} and {r.blobs for r in cut.collect()} == {"b"}

    before = texts(cut)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    clean = staged(stage["decontamination"](spark, cut, root), "t4")
    hit = {r[0] for r in brute.op4(before, items) if r[-1]}
    assert clean.columns == docs.columns and texts(clean) == [x for x in before if x[0] not in hit]

    pieces = stage["packing"](spark, clean, root).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in texts(clean)}


def kept_text(rows, k, size=200):
    """The k-th text without what repeats, cut characters left out."""
    from collections import Counter

    raw = [(t or "").encode() for _, t in rows]
    n = Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    t, gone = raw[k], set()
    for i in range(len(t) - size + 1):
        if n[t[i : i + size]] > 1:
            gone.update(range(i, i + size))
    return bytes(b for i, b in enumerate(t) if i not in gone).decode("utf-8", "ignore")


def test_run_is_the_stages_in_a_row(spark, place, tmp_path):
    import shutil

    root, _ = place
    for name in ("labels", "benchmark"):
        shutil.copytree(f"{root}/{name}.parquet", tmp_path / f"{name}.parquet")
    shutil.copytree(f"{root}/docs2/documents.parquet", tmp_path / "documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 30


def test_empty(spark, place, empty, tmp_path):
    root, _ = place
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, root), name)
        assert docs.isEmpty()
