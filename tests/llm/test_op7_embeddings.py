import numpy as np
import pytest

from corpusloom.llm import op7_embeddings as op

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def brute(rows):
    n, links = len(rows), {}
    ok = [e is not None and lab is not None and len(e) > 0 and all(v is not None and np.isfinite(v) for v in e) and any(e) for _, e, lab, _ in rows]
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    count = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float64(np.float32(rows[i][1])), np.float64(np.float32(rows[j][1]))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    count[i] += 1
                    count[j] += 1
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return {rows[i][0]: (count[i], least[find(i)]) for i in range(n)}


@pytest.mark.parametrize("limits", [(60, 100, 10**6, 1024), (60, 200, 16, 1024), (10, 40, 30, 8), (2048, 32768, 65536, 1024)])
def test_links_of_groups_and_odd_vectors(spark, monkeypatch, limits):
    for name, value in zip(("CELL", "REGION", "CHUNK", "BLOCK"), limits):
        monkeypatch.setattr(op, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 8))
    rows = []
    for i in range(500):
        v = centres[rng.integers(60)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.1, 0.4])
        rows.append((1000 - i, [float(x) for x in np.float32(v)], int(rng.integers(3)), "x"))
    rows += [(2001, None, 1, None), (2002, [0.0] * 8, 1, ""), (2003, [float("nan")] * 8, 1, ""), (2004, [None] + [1.0] * 7, 1, ""), (2005, [1.0] * 8, None, ""), (2006, [], 1, ""), (2007, [1.0, 2.0], 1, ""), (2008, [2.0, 4.0], 1, ""), (2009, [float("inf")] * 8, 1, "")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.vector_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert got == want
    assert sum(n for n, _ in want.values()) > 500


def test_different_vectors_of_one_id_and_other_labels(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [0.01, 1.0], "a"), (3, [1.0, 0.01], "a"), (4, [1.0, 0.01], "b"), (None, [1.0, 0.02], "a"), (5, [3.0, 0.0], None), (6, [1e300, 1.0], "b")]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in op.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect())
    assert got == sorted([("1", 2, 1, True), ("1", 1, 1, True), ("2", 1, 1, False), ("3", 2, 1, False), ("4", 1, 4, True), ("None", 2, 1, False), ("5", 0, 5, True), ("6", 1, 4, False)])


def test_a_dense_group_that_is_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 50)
    rng = np.random.default_rng(1)
    base = rng.normal(size=6)
    rows = [(k, [float(x) for x in np.float32(base + rng.normal(size=6) * 0.02)], 1, None) for k in range(300)]
    assert {r.vec_id: (r.n_links, r.component_id) for r in op.vector_components(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_empty_table(spark):
    assert op.vector_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kmeans_cells_are_unit():
    x = np.random.default_rng(0).normal(size=(100, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.linalg.norm(op.spherical_kmeans(x, 5), axis=1) == pytest.approx(np.ones(5))
