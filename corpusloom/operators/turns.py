"""Turns: runs of calls with less than a gap between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turns(calls: DataFrame, by: str, at: str, gap_seconds: float) -> DataFrame:
    """calls with turn, counted from 1 by key: a call opens one if it comes the gap or more after the one before.

    A session window would join calls that are just the gap apart.
    """
    w = Window.partitionBy(by).orderBy(at, "call_id")
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    since = micros - F.lag(micros).over(w)
    new = F.when(since.isNull() | (since >= int(gap_seconds * 1_000_000)), 1).otherwise(0)
    return calls.withColumn("_new", new).withColumn("turn", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")
