import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import op13_annulus as op

SCHEMA = "vec_id long, embedding array<double>, label int, x int, cluster string, n long"


def brute(rows, k, rounds, width, seed=3):
    kept = [(i, [math.floor(1024 * v) for v in e]) for i, e in rows if e is not None and len(e) == width and all(v is not None and math.isfinite(v) for v in e)]
    cents = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))[:k]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min((dist(x, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        mine = [near(x)[1] for _, x in kept]
        cents = [[sum(col) // len(col) for col in zip(*some)] if (some := [x for (_, x), m in zip(kept, mine) if m == j]) else c for j, c in enumerate(cents)]
    found = [(i, *near(x)) for i, x in kept]
    each = {j: sum(d for _, d, m in found if m == j) for j in range(len(cents))}
    return sorted(((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def ran(spark, rows, *limits):
    df = spark.createDataFrame([(i, e, 1, 2, "c", 3) for i, e in rows], SCHEMA)
    return sorted((tuple(r) for r in op.clustered(df, *limits).collect()), key=str)


def test_groups_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 50)
    monkeypatch.setattr(op, "PAIRS", 70)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 4)) * [[0.1], [1], [1], [5], [5], [30]]
    rows = [(i, [float(v) for v in centres[rng.integers(6)] + rng.normal(size=4) * 0.3]) for i in range(300)]
    # a grid has many ties; repeated rows, one vec_id twice, none, and vectors that are left out
    rows += [(500 + i, [float(a), float(b), 0.0, 0.0]) for i, (a, b) in enumerate((a, b) for a in range(-3, 4) for b in range(-3, 4))] * 2
    rows += [(1, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    odd = [(2001, None), (2002, []), (2003, [1.0] * 3), (2004, [None, 1.0, 1.0, 1.0]), (2005, [float("nan"), 1.0, 1.0, 1.0]), (2006, [float("inf")] * 4), (2007, [1e300] * 4)]
    for k, rounds in ((8, 10), (30, 3), (1, 2)):
        assert ran(spark, rows + odd, k, rounds, 3, 4) == brute(rows, k, rounds, 4)


def test_small_tables(spark):
    for rows in ([], [(1, None)], [(1, [0.5, -0.5])], [(1, [0.25, 1.0])] * 3, [(None, [0.0, 0.0]), (4, [131072.0, -131072.0])]):
        assert ran(spark, rows, 8, 10, 3, 2) == brute(rows, 8, 10, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=30), st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=12))
def test_annulus_search_is_exact(points, cents):
    number, d = op.Annulus(np.array(cents, np.int64)).nearest(np.array(points, np.int64))
    want = [min(((p - a) ** 2 + (q - b) ** 2, j) for j, (a, b) in enumerate(cents)) for p, q in points]
    assert list(zip(d.tolist(), number.tolist())) == want


def test_annulus_compares_few_where_norms_differ():
    rng = np.random.default_rng(0)
    cents = (rng.normal(size=(200, 8)) * np.arange(1, 201)[:, None] * 100).astype(np.int64)
    x = cents[rng.integers(200, size=1000)] + rng.integers(-5, 6, size=(1000, 8))
    a = op.Annulus(cents)
    number, d = a.nearest(x)
    every = ((x[:, None] - cents) ** 2).sum(2)
    assert (d == every.min(1)).all() and (number == every.argmin(1)).all()
    assert a.compared < every.size * 0.75


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_the_sql_gives_the_same(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}'")
    cols = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    want = con.execute(f"select {cols} from ({op.oracle_sql()})").fetchall()
    got = [tuple(r) for r in op.clustered(spark.read.parquet(path)).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
