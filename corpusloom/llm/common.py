"""Shared helpers: scratch tables, word hashing on Arrow buffers, streaming groups."""

from __future__ import annotations

import contextlib
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text hashed at once; bounds the temporaries of a Python worker.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~_SPACE
#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd base of the rolling hash and its inverse modulo 2**64.
_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode, and else an error, since executors don't share the driver's disk."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: it names the folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table behind a DataFrame made by stored(); nothing may read it any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Ask the driver to collect garbage, so that shuffle files of finished jobs are deleted; what one pass finds is only freed by the next."""
    for _ in range(3):
        spark._jvm.System.gc()
        time.sleep(0.1)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside pass at most so many rows to a Python worker at once: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), vectorised."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, kind: str = "up") -> np.ndarray:
    """Powers 0..n-1 of the hash base ("up") or of its inverse ("down"), modulo 2**64."""
    have = _POWERS[kind]
    if len(have) < n:
        base = _BASE if kind == "up" else _BASE_INV
        while len(have) < n:
            step = np.uint64(pow(base, len(have), 1 << 64))
            have = np.concatenate((have, have * step))
        _POWERS[kind] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[k] = sum of value(data[j]) * base**j for j < k."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end], equal for equal bytes wherever they stand."""
    n = len(prefix)
    return mix((prefix[ends] - prefix[starts]) * powers(n, "down")[starts] + (ends - starts).astype(np.uint64) * _M2)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def _ranges(at: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    first, n = 0, len(at) - 1
    while first < n:
        end = min(n, first + rows, max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1))
        yield first, end
        first = end


def row_ranges(column: pa.Array, most: int, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """(first row, end row) of at most so many rows with at most so many bytes, or a single longer row."""
    yield from _ranges(buffers(column)[1], most, rows)


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of at most so many rows with at most so many bytes, or a single longer row."""
    data, at = buffers(column)
    for first, end in _ranges(at, most, rows):
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]


def parts_of_rows(column: pa.Array, most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool, bool]]:
    """slices() with flags whether it begins and ends its rows: a longer row comes in parts of about so many bytes, cut at ASCII white space."""
    for first, end, data, at in slices(column, most, rows):
        if len(data) <= most:
            yield first, end, data, at, True, True
            continue
        gaps = np.flatnonzero(_SPACE[data])
        a = 0
        while a < len(data):
            k = int(np.searchsorted(gaps, a + most))
            b = int(gaps[k]) if k < len(gaps) else len(data)
            yield first, end, data[a:b], np.array([0, b - a]), not a, b == len(data)
            a = b


_ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]")


def space_cuts(text: str, most: int) -> Iterator[str]:
    """Parts of a text of about so many characters, each but the first beginning with ASCII white space."""
    a = 0
    while a < len(text):
        found = _ASCII_SPACE.search(text, a + most)
        b = found.start() if found else len(text)
        yield text[a:b]
        a = b


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then the same of starts[1] and so on."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of some rows, A-Z lower-cased: hash, row and place of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = LOWER[data]
        word = _WORD[data]
        n = len(data)
        edge = at[:-1][at[:-1] < n]
        before = np.empty(n, bool)
        before[1:] = word[:-1]
        before[:1] = False
        before[edge] = False
        self.starts = np.flatnonzero(word & ~before)
        after = np.empty(n, bool)
        after[:-1] = word[1:]
        after[n - 1 :] = False
        last = at[1:][at[1:] > 0] - 1
        after[last] = False
        self.ends = np.flatnonzero(word & ~after) + 1
        self.hashes = span_hashes(prefix_hashes(data), self.starts, self.ends)
        #: Index of the first word of each row, and the number of words at the end.
        self.first = np.searchsorted(self.starts, at)
        self.rows = np.repeat(np.arange(len(at) - 1), np.diff(self.first))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys from batches sorted by them; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            new = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and new != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = new
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def by_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a short name."""
    return df.mapInArrow(f, schema)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
