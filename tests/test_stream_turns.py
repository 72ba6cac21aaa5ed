"""Turns of a stream by event time: late calls, calls out of order, keys that are forgotten, a restart, and the batch query."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import turns
from corpusloom.streaming.turns import stream_turns

SCHEMA = "key string, call_id long, at timestamp"


def arrives(spark, folder, rows):
    """One more file of calls (key, call_id, seconds)."""
    table = spark.createDataFrame(rows, "key string, call_id long, s double")
    table.select("key", "call_id", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(folder)


def started(spark, folder, state, name, **how):
    calls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream_turns(calls, **how).writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", state).start()


def ran(spark, folder, state, **how):
    q = started(spark, folder, state, "t", **how)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return {(r.key, r.call_id): (r.turn, r.opened.timestamp()) for r in spark.read.parquet(f"{folder}-out").collect()}


def plain(spark, rows, gap):
    table = spark.createDataFrame(rows, "key string, call_id long, s double").withColumn("at", F.timestamp_seconds("s"))
    return {(r.key, r.call_id): r.turn for r in turns.turns(table, "key", "at", gap).collect()}


def test_calls_in_any_order_give_what_the_batch_query_gives(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, float(rng.randrange(0, 240)) / 2) for i in range(150)] + [("a", 900, 500.0)]
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    # each file's calls are out of order and overlap in time with those of the next by less than 30 s
    ordered = sorted(rows, key=lambda r: r[2] + rng.random() * 10)
    got = {}
    for a in range(0, len(ordered), 60):
        arrives(spark, folder, ordered[a : a + 60])
        got = ran(spark, folder, state, gap_seconds=2, late_seconds=30)  # started anew from its checkpoint each time
    want = plain(spark, rows, 2)
    assert {k: t for k, (t, _) in got.items()} == {k: t for k, t in want.items() if k != ("a", 900)}  # the watermark hasn't passed the last call


def test_late_calls_and_forgotten_keys(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    how = {"gap_seconds": 1, "late_seconds": 5, "forget_seconds": 60}
    arrives(spark, folder, [("a", 1, 10.0), ("a", 2, 10.9), ("a", 3, 11.9), ("a", None, 12.2)])
    ran(spark, folder, state, **how)
    arrives(spark, folder, [("b", 4, 100.0)])
    ran(spark, folder, state, **how)
    # behind the watermark of 95 s: left out; ahead of it: by now the key is forgotten and counts anew
    arrives(spark, folder, [("a", 5, 50.0), ("a", 6, 99.0)])
    ran(spark, folder, state, **how)
    arrives(spark, folder, [("b", 7, 300.0)])
    got = ran(spark, folder, state, **how)
    assert got == {("a", 1): (1, 10.0), ("a", 2): (1, 10.0), ("a", 3): (2, 11.9), ("a", None): (2, 11.9), ("b", 4): (1, 100.0), ("a", 6): (1, 99.0)}


def test_a_key_is_not_forgotten_within_a_turn(spark):
    with pytest.raises(ValueError):
        stream_turns(spark.readStream.format("rate").load().select(F.lit("k").alias("key"), F.col("value").alias("call_id"), F.col("timestamp").alias("at")), 10, forget_seconds=5)
