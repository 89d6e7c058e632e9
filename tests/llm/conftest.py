import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, kid int, row string, blobs string, words int, score string, term string, `path` string"


def make(spark, rows, path):
    """A table of (doc_id, text) with further columns, some of them named as operators name theirs, as written Parquet."""
    full = [(i, t, ("en", "fr", None)[k % 3], f"s{k % 2}", None if t is None else len(t), "u", k, "r", "b", k, "s", "t", "p") for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def odd_rows():
    """Nulls, empty texts, white space, a very long text, copies, near copies, repeated rows, shared passages, odd letters."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(400)]

    def text(n):
        return " ".join(r.choice(words) + r.choice(["", "", "", ".", ",", "!\n"]) for _ in range(n)) + "."

    base, passage = text(120), text(70)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "One"), (4, "one two"), (5, "ONE"), (6, text(30_000)), (7, base), (8, base), (8, base), (9, base.replace("a", "b", 1)), (10, base.upper())]
    rows += [(11, passage + "\n" + text(90)), (12, text(80) + "\n" + passage), (13, "a" * 700), (14, "ab" * 300), (15, "é日本 ñ" * 120), (16, "x y z \x1c \x85 end"), (17, None), (17, None), (18, "the same line.\n" * 40), (19, "|".join(["Home", "Menu", "Login"] * 40))]
    rows += [(20 + k, text(r.randint(1, 200))) for k in range(30)]
    near = text(100).split(" ")
    for k in range(25):
        w = list(near)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((60 + k, " ".join(w)))
    return rows


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    rows = odd_rows()
    return rows, make(spark, rows, str(tmp_path_factory.mktemp("odd") / "docs"))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return make(spark, [], str(tmp_path_factory.mktemp("none") / "docs"))
