import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm.knn import knn_join, quantised

SCHEMA = "vec_id long, embedding array<float>, label int, cell long, dist double, grp int"


def plain(rows, k):
    out = []
    for q, v in sorted({i: v for i, v in sorted(rows, key=lambda r: (r[0], r[1])) if i % 20 == 0}.items()):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


def ask(df, **options):
    data = df.select("vec_id", quantised("embedding").alias("vec"))
    return sorted(map(tuple, knn_join(data, F.col("vec_id") % 20 == 0, **options).collect()))


def ints(v):
    return [int(__import__("math").floor(64 * float(x))) for x in v]


@pytest.mark.parametrize("options", [{}, {"pivots": 7, "queries": 3, "slice_rows": 50}, {"pivots": 1, "k": 3}, {"k": 500, "slice_rows": 60}])
def test_against_brute_force(spark, options):
    rng = random.Random(2)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    vectors = [[c + rng.gauss(0, 0.1) for c in rng.choice(centres)] for _ in range(200)] + [[0.5] * 8] * 100
    rows = [(i, [float(__import__("struct").unpack("f", __import__("struct").pack("f", x))[0]) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, 1, 2, 0.5, 3) for i, v in rows], SCHEMA)
    assert ask(df, **options) == plain([(i, ints(v)) for i, v in rows], options.get("k", 20))


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [2.0]), (20, [-1.0, 0.0]), (8, [1000.0, -1000.0])]
    df = spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], SCHEMA)
    usable = [(i, ints(v)) for i, v in rows if i is not None and i not in (2, 3, 4, 5)]
    assert ask(df) == plain(usable, 20)
    assert ask(df.where("false")) == [] and ask(df.where("vec_id = 1")) == []
    assert ask(df.where("vec_id = 20")) == []


@pytest.mark.parametrize("norms", [False, True])
def test_rings_leave_rows_out(spark, norms):
    """On clusters that lie apart few pairs are compared and few rows are sent, and nothing is lost."""
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    v = centres[np.arange(8000) % 40] + draw.normal(0, 0.02, (8000, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if norms:
        v *= draw.uniform(0.5, 2, (8000, 1))
    v = np.floor(640 * v).astype(int)
    data = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, vec array<long>")
    report = {}
    got = {}
    for r in knn_join(data, F.col("vec_id") % 20 == 0, report=report).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    scores = v[::20] @ v.T
    for i, s in enumerate(scores):
        order = sorted((-int(x), j) for j, x in enumerate(s) if j != 20 * i)[:20]
        assert sorted(got[20 * i]) == [(n + 1, *x) for n, x in enumerate(order)]
    assert (report["rows"], report["queries"]) == (8000, 400) and report["groups"] > 1
    assert report["compared"] < 0.3 * 8000 * 400 and report["sent"] < 0.3 * 8000 * report["groups"]


def test_groups_of_what_needs_the_same(spark):
    """Where no ring leaves rows out, the rows are sent once for all the queries that a task can take."""
    rng = random.Random(7)
    rows = [(i, [rng.randrange(-60, 60) for _ in range(24)]) for i in range(1500)]
    report = {}
    got = knn_join(spark.createDataFrame(rows, "vec_id long, vec array<long>"), F.col("vec_id") % 20 == 0, report=report)
    assert sorted(map(tuple, got.collect())) == plain(rows, 20)
    assert report["groups"] == 1 and report["sent"] <= 1500


def test_zero_vectors_and_ties(spark):
    rows = [(i, [0, 0]) for i in range(0, 80, 20)] + [(i, [3, 4]) for i in range(1, 40)] + [(100, [3, 4]), (120, [-3, -4])]
    data = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    for options in ({}, {"k": 2, "queries": 1, "slice_rows": 5}):
        assert sorted(map(tuple, knn_join(data, F.col("vec_id") % 20 == 0, **options).collect())) == plain(rows, options.get("k", 20))


def test_own_rows_do_not_fill_the_bound(spark):
    """A query id of many equal rows, alone in its cell, still gets its k neighbours."""
    rng = random.Random(5)
    others = [[9, 1, 0], [0, 8, 3], [-7, 2, 5], [1, -6, 4]]
    rows = [(20, [90, 90, 90])] * 25 + [(i, rng.choice(others)) for i in range(100) if i % 20]
    data = spark.createDataFrame(rows, "vec_id long, vec array<long>")
    got = knn_join(data, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == plain(rows, 20)
