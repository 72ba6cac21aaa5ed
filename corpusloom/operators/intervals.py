"""Runs, blocks and nesting of line ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.scan import differs, running
from corpusloom.sources.scratch import stored


def merged(rows: DataFrame, by: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """by, start_line, end_line, parts: ranges of a key that touch (next to each other) or overlap become one."""
    w = Window.partitionBy(by).orderBy(start, end)
    past = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(past.isNull() | (F.col(start) > past + 1), 1).otherwise(0)
    blocks = rows.withColumn("_new", new).withColumn("_block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return blocks.groupBy(by, "_block").agg(F.min(start).alias("start_line"), F.max(end).alias("end_line"), F.count("*").alias("parts")).drop("_block")


#: Ranges of a key are compared in blocks of 2**BITS, and blocks with each other by running totals.
BITS = 16


def earlier_at_least(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row, how many earlier rows of its group (rows of a group stand together) have at least its value: halves are compared by sorting, from pairs up."""
    n = len(group)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    local = np.arange(n) - np.repeat(first, np.diff(first, append=n))
    for level in range(int(local.max()).bit_length()):
        right = (local >> level & 1).astype(bool)
        new = (local & ((2 << level) - 1)) == 0
        block = np.cumsum(new)
        # greater values first, and left halves first among equal ones
        order = np.lexsort((right, ~value, block))
        left = np.cumsum(~right[order])
        begun = np.flatnonzero(np.diff(block, prepend=0))
        base = np.repeat(left[begun] - ~right[order][begun], np.diff(begun, append=n))
        some = right[order]
        out[order[some]] += (left - base)[some]
    return out


def _within(by: str):
    """Rows sorted by (key, _block, _rank), with _depth: those before it in the block that reach as far."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            new = np.ones(t.num_rows, bool)
            new[1:] = differs(t.column(by)) | differs(t.column("_part"))
            depth = earlier_at_least(np.cumsum(new), t.column("_end").to_numpy())
            return pa.RecordBatch.from_arrays([*t.columns, pa.array(depth)], [*t.schema.names, "_depth"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in (by, "_part"):
                new[1:] |= differs(batch.column(k))
                if held:
                    new[0] |= differs(pa.concat_arrays([held[-1].column(k).slice(held[-1].num_rows - 1), batch.column(k).slice(0, 1)]))[0]
            cut = np.flatnonzero(new)
            # whole blocks go on, the last one may not be whole yet
            if len(cut):
                if held or cut[-1]:
                    yield done([*held, batch.slice(0, int(cut[-1]))])
                held = []
                batch = batch.slice(int(cut[-1]))
            held.append(batch)
        if held:
            yield done(held)

    return f


#: Keys of more than 2**BITS ranges that are broadcast at most; more are joined by shuffle.
BROADCAST_KEYS = 10_000


def nested(rows: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """rows with depth: 1 and the number of other ranges of the key that contain it (of equal ones, those before it by `ord`; equal in that too, they count in some order).

    A range is in those that come before it by start and, reversed, by end, and
    reach as far: that is counted in n log n, without a join of ranges. Keys of up
    to 2**BITS ranges go to one task each. Those of more are ranked by running
    totals and compared in blocks of 2**BITS; each level of doubling is one more
    running total over halves, sorted by end, so that a key of any size is dealt
    over tasks. Starts and ends are whole numbers. A null key, start or end has
    depth 1 and is around nothing; an empty table gives an empty one.
    """
    names = rows.columns
    sound = F.col(by).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()
    base = rows.where(sound).select(*names, F.col(end).cast("long").alias("_end"), F.bitwise_not(F.col(end).cast("long")).alias("_down"))
    large = base.groupBy(by).count().where(F.col("count") > 1 << BITS).select(by)
    n_large = large.limit(BROADCAST_KEYS + 1).count()
    small = base
    if n_large:
        large = F.broadcast(large) if n_large <= BROADCAST_KEYS else large
        small = base.join(large, by, "left_anti")
    small = small.select(*base.columns, F.lit(0).cast("long").alias("_part"))
    order = [start, "_down", "ord"]
    done = _compared(small.repartition(by).sortWithinPartitions(by, *order), by)
    if n_large:
        done = done.select(*names, "_depth").unionByName(_in_blocks(base.join(large, by, "left_semi"), by, order).select(*names, "_depth"))
    rest = rows.where(~sound).select(*names, F.lit(1).cast("long").alias("depth"))
    return done.select(*names, (F.col("_depth") + 1).alias("depth")).unionByName(rest)


def _compared(rows: DataFrame, by: str) -> DataFrame:
    """rows, sorted by (key, _part) and then as they contain each other, with _depth within their part."""
    return rows.mapInArrow(_within(by), T.StructType([*rows.schema.fields, T.StructField("_depth", T.LongType())]))


def _in_blocks(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The ranges of keys that have many blocks, with _depth."""
    ranked = running(rows.withColumn("_one", F.lit(1)), [by], order, {"_rank": "_one"}).drop("_one")
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1).withColumn("_part", F.shiftright("_rank", BITS))
    high = stored(_compared(ranked.repartition(by, "_part").sortWithinPartitions(by, "_part", "_rank"), by))
    top = high.agg(F.max("_rank")).first()[0] or 0
    for level in range(BITS, top.bit_length()):
        halves = high.withColumn("_half", F.shiftright("_rank", level).bitwiseAND(1)).withColumn("_part", F.shiftright("_rank", level + 1)).withColumn("_left", 1 - F.col("_half"))
        counted = running(halves, [by, "_part"], ["_down", "_half", "_rank"], {"_before": "_left"})
        high = counted.withColumn("_depth", F.col("_depth") + F.col("_half") * F.col("_before")).drop("_half", "_left", "_before")
    return high


def subtotals(rows: DataFrame, amount: str) -> DataFrame:
    """rows (rank, amount) with the running sum in order of rank: for a page, whose rows are few."""
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("subtotal", F.sum(amount).over(w))
