import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import intervals

SCHEMA = "k string, start long, end long, ord long"


def plain(rows):
    def around(b, a):
        return None not in (*a[:3], *b[:3]) and b[0] == a[0] and b[1] <= a[1] and b[2] >= a[2] and (b[1] < a[1] or b[2] > a[2] or b[3] < a[3])

    return sorted(((*a, 1 + sum(around(b, a) for b in rows)) for a in rows), key=str)


@pytest.mark.parametrize("bits", [2, 4, 16])
def test_depths_of_keys_of_one_and_many_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(intervals, "BITS", bits)
    rng = random.Random(bits)
    keys = ["hot"] * 250 + [rng.choice("abcdefg") for _ in range(150)] + ["one"] + [None] * 3
    rows = [(k, s := rng.randrange(30), s + rng.randrange(25), i) for i, k in enumerate(keys)]
    rows += [("hot", None, 3, 900), ("hot", 3, None, 901), ("hot", 5, 2, 902), ("hot", -(1 << 62), 1 << 62, 903)]
    rng.shuffle(rows)
    out = intervals.nested(spark.createDataFrame(rows, SCHEMA), "k")
    assert out.columns == ["k", "start", "end", "ord", "depth"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(rows)


def test_rows_that_are_equal_in_all(spark):
    rows = [("a", 1, 5, 0)] * 3 + [("a", 2, 3, 0)]
    assert sorted(r.depth for r in intervals.nested(spark.createDataFrame(rows, SCHEMA), "k").collect()) == [1, 2, 3, 4]
    assert intervals.nested(spark.createDataFrame([], SCHEMA), "k").collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-4, 4)), max_size=60))
def test_earlier_rows_that_are_as_great(pairs):
    pairs.sort(key=lambda p: p[0])
    group, value = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    want = [sum(g == pairs[i][0] and v >= pairs[i][1] for g, v in pairs[:i]) for i in range(len(pairs))]
    assert intervals.earlier_at_least(group, value).tolist() == want


def test_a_key_of_many_ranges(spark):
    """300,000 ranges of one key, each inside the one before, and half as many beside them: 4.5e10 pairs if they were all compared."""
    n = 300_000
    ids = spark.range(n)
    rows = ids.select(F.lit("k").alias("k"), F.col("id").alias("start"), (2 * n - F.col("id")).alias("end"), F.col("id").alias("ord"))
    rows = rows.unionByName(spark.range(n // 2).select(F.lit("k").alias("k"), (F.col("id") + 3 * n).alias("start"), (F.col("id") + 3 * n).alias("end"), (F.col("id") + n).alias("ord")))
    t = time.time()
    x = intervals.nested(rows, "k").groupBy().agg(F.sum((F.col("depth") == F.when(F.col("ord") < n, F.col("ord") + 1).otherwise(1)).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert x.n == x.right == n + n // 2
    assert time.time() - t < 120
