"""Running totals over sorted rows in two passes, so that a key of any size is dealt over tasks.

Rows are ranged by key and order. The first pass adds up within each range; of
each range only its first and last row come to the driver, which finds what a
key has gathered before a range; the second pass adds that to the rows of the
key with which the range begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.scratch import stored

_EDGES = [T.StructField("_scan_block", T.IntegerType()), T.StructField("_scan_head", T.BooleanType()), T.StructField("_scan_edge", T.IntegerType())]


def differs(column: pa.Array) -> np.ndarray:
    """For each row but the first, whether it differs from the one before it; null equals null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    unlike = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unlike, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def running_batches(batches: Iterator[pa.RecordBatch], by: list[str], totals: dict[str, str], block: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches of one range with running totals, the range's number, whether a row is of its first key, and 1 for its first row plus 2 for its last."""
    held, carry, head, begun = None, dict.fromkeys(totals, 0), True, False
    before: pa.RecordBatch | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in by:
            column = batch.column(k)
            new[1:] |= differs(column)
            if before is not None:
                new[0] |= differs(pa.concat_arrays([before.column(k), column.slice(0, 1)]))[0]
        starts = np.flatnonzero(new)
        segment = np.cumsum(new)
        columns = []
        for name, source in totals.items():
            x = pc.fill_null(batch.column(source), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            c = np.cumsum(x)
            # what each run began with: the carry of the key before, or minus all that came before the run
            base = np.concatenate(([carry[name]], x[starts] - c[starts]))
            c = c + base[segment]
            carry[name] = int(c[-1])
            columns.append(pa.array(c))
        in_head = (segment == 0) & head
        head = bool(in_head[-1])
        edge = np.zeros(n, np.int32)
        if not begun:
            edge[0], begun = 1, True
        before = batch.slice(n - 1, 1)
        out = (batch, columns, in_head, edge)
        if held is not None:
            yield _made(held, totals, block)
        held = out
    if held is not None:
        held[3][-1] += 2
        yield _made(held, totals, block)


def _made(held: tuple, totals: dict[str, str], block: int) -> pa.RecordBatch:
    batch, columns, in_head, edge = held
    extra = [pa.array(np.full(batch.num_rows, block, np.int32)), pa.array(in_head), pa.array(edge)]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns, *extra], [*batch.schema.names, *totals, "_scan_block", "_scan_head", "_scan_edge"])


def carried(edges: list[dict], by: list[str], totals: list[str]) -> dict[int, list[int]]:
    """For each range that begins inside a key: what that key has gathered in the ranges before."""
    out: dict[int, list[int]] = {}
    key, sums = None, None
    for e in sorted(edges, key=lambda e: (e["_scan_block"], e["_scan_edge"] == 2)):
        k = tuple(e[c] for c in by)
        if e["_scan_edge"] in (1, 3) and sums is not None and k == key:
            out[e["_scan_block"]] = sums
        if e["_scan_edge"] in (2, 3):
            own = [e[t] for t in totals]
            carry = out.get(e["_scan_block"]) if e["_scan_head"] else None
            key, sums = k, [a + b for a, b in zip(own, carry)] if carry else own
    return out


def running(rows: DataFrame, by: list[str], order: list[str], totals: dict[str, str], ranged: list[str] | None = None) -> DataFrame:
    """rows with, for each item (name: column) of totals, the column's sum over the rows of the same key up to and with this one.

    by and order are columns that can be sorted, nulls first; a null key is a
    key, and a null amount is 0. Rows that are equal in all of them stand in some
    order and in one task, so the order should be total where they can be many.
    Sums are of 64 bits. The driver gets two rows for each range, and a sample of
    the columns that rows are ranged by: where those are long texts, ranged names
    others that sort alike. An empty table gives an empty one.
    """
    keys = [*dict.fromkeys([*by, *order])]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(t, T.LongType()) for t in totals), *_EDGES])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return running_batches(batches, by, totals, TaskContext.get().partitionId())

    done = stored(rows.repartitionByRange(*(ranged or keys)).sortWithinPartitions(*keys).mapInArrow(f, schema))
    # two rows for each range
    edges = [r.asDict() for r in done.where("_scan_edge > 0").select(*by, *totals, "_scan_block", "_scan_head", "_scan_edge").collect()]
    carry = carried(edges, by, list(totals))
    if not carry:
        return done.drop("_scan_block", "_scan_head", "_scan_edge")
    names = [f"_carry_{t}" for t in totals]
    table = rows.sparkSession.createDataFrame([(b, *c) for b, c in carry.items()], "_scan_block int, " + ", ".join(f"{n} long" for n in names))
    # at most a row for each range
    joined = done.join(F.broadcast(table), "_scan_block", "left")
    sums = [(F.col(t) + F.when(F.col("_scan_head"), F.coalesce(F.col(n), F.lit(0))).otherwise(0)).alias(t) for t, n in zip(totals, names)]
    return joined.select(*rows.columns, *sums)
