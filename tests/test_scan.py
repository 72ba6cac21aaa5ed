import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import scan


def plain(rows):
    out, sums = [], {}
    for key, order, amount in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        sums[key] = sums.get(key, 0) + (amount or 0)
        out.append((key, order, sums[key]))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_running_totals_of_keys_that_span_ranges(spark, ranges):
    rng = random.Random(ranges)
    # a key with nine of ten rows, keys of one row, and a null key
    keys = ["hot"] * 900 + [f"k{i}" for i in range(60)] + ["z"] * 30 + [None] * 10
    rows = [(k, i, rng.choice([None, -3, 1, 5])) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        out = scan.running(spark.createDataFrame(rows, "k string, i long, n long"), ["k"], ["i"], {"total": "n"})
        assert sorted(((r.k, r.i, r.total) for r in out.collect()), key=str) == plain(rows)
        assert out.columns == ["k", "i", "n", "total"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_rows(spark):
    assert scan.running(spark.createDataFrame([], "k string, i long"), ["k"], ["i"], {"n": "i"}).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-2, 5)), max_size=40), st.lists(st.integers(0, 40), max_size=5), st.integers(1, 7))
def test_any_cut_into_ranges_and_batches(pairs, cuts, size):
    import pyarrow as pa

    rows = sorted(pairs, key=lambda r: r[0])
    bounds = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    done = []
    for block, (a, b) in enumerate(itertools.pairwise(bounds)):
        part = rows[a:b]
        batches = [pa.RecordBatch.from_pydict({"k": [r[0] for r in part[i : i + size]], "n": [r[1] for r in part[i : i + size]]}) for i in range(0, len(part), size)]
        for out in scan.running_batches(iter(batches), ["k"], {"t": "n"}, block):
            done += out.to_pylist()
    carry = scan.carried([r for r in done if r["_scan_edge"]], ["k"], ["t"])
    got = [r["t"] + (carry.get(r["_scan_block"], [0])[0] if r["_scan_head"] else 0) for r in done]
    want = [sum(n for k, n in rows[: i + 1] if k == rows[i][0]) for i in range(len(rows))]
    assert got == want
