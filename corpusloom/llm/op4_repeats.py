"""Removal of long repeated byte strings by distributed suffix arrays.

Every string of SPAN bytes holds an anchor that its content alone decides: the
least hash of its strings of GRAM bytes. So all copies of a string have their
anchors in one place, and meet in one group by that anchor's hash. Where the
surroundings of two anchors are equal as a whole, by two hashes of 64 bits, their
strings are repeats. The others, at the edges of repeats, are cut into blocks
whose names form a text; its suffix array (see suffixes.py) gives the
surroundings that share enough blocks, and the strings beside these blocks are
compared byte by byte. Texts are known by two hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from corpusloom.llm.common import BYTE_VALUES, buffers, by_arrow, mix, powers, prefix_hashes, released, slices, span_hashes, stored
from corpusloom.llm.suffixes import suffix_array

SPAN, GRAM = 200, 100
#: Bytes of a block, and how many whole ones any SPAN bytes hold.
BLOCK, BLOCKS = 50, 3
#: An anchor with more different surroundings is settled by a shuffle of its strings' hashes.
GROUP_LIMIT = 4096
#: Low bits of an anchor's place: as many in all slices, which hold at most so many bytes, so that all choose the same anchors.
PLACE_BITS = 21
#: Surroundings sorted at once, about.
SORTED_AT_ONCE = 8192
#: Rows of a few longs that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor place, first and last start of strings that have it, anchor hash, two hashes of the surroundings); places within the row."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 3
    if n < SPAN:
        return none
    prefix = prefix_hashes(data)
    grams = n - GRAM + 1
    g = mix((prefix[GRAM:] - prefix[:grams]) * powers(grams, "down"))
    if n > 1 << PLACE_BITS:
        raise ValueError("a slice is too long")
    bits = np.uint64((1 << PLACE_BITS) - 1)
    least = (g & ~bits) | np.arange(grams, dtype=np.uint64)
    width, want = 1, SPAN - GRAM + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    # least[i]: of the string that starts at i; only strings inside a row count
    starts = len(least)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:starts]
    inside = np.arange(starts) + SPAN <= at[1:][row]
    i = np.flatnonzero(inside)
    if not len(i):
        return none
    p = (least[i] & bits).astype(np.int64)
    new = np.flatnonzero(np.diff(p, prepend=-1))
    lo, hi = i[new], i[np.append(new[1:], len(i)) - 1]
    p = p[new]
    around = span_hashes(prefix, lo, hi + SPAN) + (p - lo).astype(np.uint64) * BYTE_VALUES[3]
    # besides, the sum of the mixed hashes of all grams of the surroundings
    sums = np.zeros(grams + 1, np.uint64)
    np.cumsum(mix(g), out=sums[1:])
    again = mix(sums[hi + SPAN - GRAM + 1] - sums[lo] + (hi - lo).astype(np.uint64) * BYTE_VALUES[5])
    begun = at[:-1][row[lo]]
    return row[lo], p - begun, lo - begun, hi - begun, g[p], mix(around), again


#: Bytes of a text that are looked at together.
PIECE = 1 << 20
#: Rows of a scan that are looked at together, and rows of an anchor there from which on they are spread.
HELD, SPREAD = 400_000, 64
NAMES = ["route", "anchor", "around", "again", "text_id", "p", "lo", "hi", "state"]
ANCHORS = "route long, anchor long, around long, again long, text_id long, p int, lo int, hi int, state int"


def _typed(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32 if k in ("p", "lo", "hi", "state") else np.int64)) for k, v in x.items()], list(x))


def _spread(x: dict[str, np.ndarray], spread: int) -> dict[str, np.ndarray]:
    """Settles, within a scan, much of what belongs to frequent anchors, so that none gathers in one task.

    Of more than two rows with one surroundings the others are repeats as a
    whole (state 1, dealt at random). Of more than two surroundings of an
    anchor the others are known to be among several (state 2) and dealt by
    anchor and surroundings; should the same ones come by the anchor alone
    elsewhere, both go on and meet when they are settled.
    """
    order = np.lexsort((x["again"], x["around"], x["anchor"]))
    x = {k: v[order] for k, v in x.items()}
    n = len(order)
    new_group = np.diff(x["anchor"], prepend=~x["anchor"][:1]) != 0
    new_run = new_group | (np.diff(x["around"], prepend=~x["around"][:1]) != 0) | (np.diff(x["again"], prepend=~x["again"][:1]) != 0)
    group, run = np.cumsum(new_group) - 1, np.cumsum(new_run) - 1
    group_at, run_at = np.flatnonzero(new_group), np.flatnonzero(new_run)
    hot = (np.diff(group_at, append=n) > spread)[group]
    again = hot & (np.arange(n) - run_at[run] >= 2)
    more = hot & ~again & (run - run[group_at][group] >= 2)
    x["state"] = np.where(again, 1, np.where(more, 2, 0))
    route = x["anchor"].copy()
    text = (x["text_id"] + x["lo"]).view(np.uint64)
    route[again] = mix(text[again]).view(np.int64)
    route[more] = mix(x["anchor"][more].view(np.uint64) ^ mix(x["around"][more].view(np.uint64))).view(np.int64)
    return {"route": route, **x}


def _anchored(piece: int, spread: int):
    """Anchors of texts (text_id, text), frequent ones dealt by _spread()."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        names = NAMES[1:-1]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, at in slices(batch.column(1), piece):
                # a longer text is looked at in pieces, each with the strings that start in it
                for begin in range(0, max(1, len(data)), piece):
                    if len(data) <= piece:
                        row, p, lo, hi, g, around, again = anchors(data, at)
                    else:
                        part = data[begin : begin + piece + SPAN - 1]
                        row, p, lo, hi, g, around, again = anchors(part, np.array([0, len(part)]))
                        p, lo, hi = p + begin, lo + begin, hi + begin
                    held.append((g.view(np.int64), around.view(np.int64), again.view(np.int64), ids[a:b][row], p, lo, hi))
                    size += len(p)
                    if size >= HELD:
                        yield _typed(_spread({k: np.concatenate(c) for k, c in zip(names, zip(*held))}, spread))
                        held, size = [], 0
        if size:
            yield _typed(_spread({k: np.concatenate(c) for k, c in zip(names, zip(*held))}, spread))

    return f


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by route and surroundings: repeats as a whole (mixed null), and one row for each surroundings of an anchor that has several (mixed: whether it is alone).

    Two rows are held over between batches, however large a group is.
    """
    held = {k: np.zeros(0, np.int64) for k in NAMES}
    held_known = np.zeros(0, bool)
    several = False  # the held run's anchor had another run before it

    def rows(x: dict, at: np.ndarray, mixed: pa.Array) -> pa.RecordBatch:
        out = _typed({k: x[k][at] for k in ("anchor", "text_id", "p", "lo", "hi")})
        return pa.RecordBatch.from_arrays([*out.columns, mixed], [*out.schema.names, "mixed"])

    def taken(x: dict, known: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, held_known, several
        n = len(known)
        if not n:
            return
        new_group = np.diff(x["route"], prepend=~x["route"][:1]) != 0
        new_run = new_group | (np.diff(x["around"], prepend=~x["around"][:1]) != 0) | (np.diff(x["again"], prepend=~x["again"][:1]) != 0)
        run_at = np.flatnonzero(new_run)
        run = np.cumsum(new_run) - 1
        length = np.diff(run_at, append=n)
        group = (np.cumsum(new_group) - 1)[run_at]
        runs = np.bincount(group)
        if several:
            runs[0] += 1
        open_ = len(run_at) - (not last)  # runs from here on may go on
        again = (length[run] >= 2) & ~known
        if again.any():
            at = np.flatnonzero(again)
            yield rows(x, at, pa.nulls(len(at), pa.bool_()))
        mixed = np.flatnonzero((runs[group[:open_]] >= 2) | (x["state"][run_at[:open_]] == 2))
        if len(mixed):
            yield rows(x, run_at[mixed], pa.array(length[mixed] == 1))
        if not last:
            rest = np.arange(run_at[-1], n)[:2]
            several = bool(runs[-1] >= 2)
            held = {k: v[rest] for k, v in x.items()}
            held_known = (length[-1] >= 2) | known[rest]

    for batch in batches:
        x = {k: batch.column(k).to_numpy().astype(np.int64) for k in NAMES}
        settled = x["state"] == 1
        if settled.any():
            at = np.flatnonzero(settled)
            yield rows(x, at, pa.nulls(len(at), pa.bool_()))
            x = {k: v[~settled] for k, v in x.items()}
        x = {k: np.concatenate((held[k], v)) for k, v in x.items()}
        yield from taken(x, np.concatenate((held_known, np.zeros(len(x["route"]) - len(held_known), bool))), False)
    yield from taken(held, held_known, True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, marks): the surroundings of each mark, for the strings that reach far to the left of the anchor and for the others."""
    for batch in batches:
        data, at = buffers(batch.column("text"))
        for k, marks in enumerate(batch.column("marks").to_pylist()):
            text = data[at[k] : at[k + 1]]
            out: list[tuple] = []
            for m in marks:
                p, lo, hi = m["p"], m["lo"], m["hi"]
                for side, (a, b) in enumerate(((lo, min(hi, p - BLOCK)), (max(lo, p - BLOCK + 1), hi))):
                    if a <= b:
                        out.append((m["anchor"] ^ (side * 0x5DEECE66D), m["text_id"], p, a, b, m["mixed"], text[a : b + SPAN].tobytes()))
            if out:
                cols = list(zip(*out))
                around = [hash_bytes(x, p - a) for x, p, a in zip(cols[6], cols[2], cols[3])]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(around, pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:5]), pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.binary())], ["key", "around", "text_id", "p", "lo", "hi", "alone", "bytes"])


def hash_bytes(x: bytes, shift: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(x, seed=shift) - (1 << 63)


def repeated(matrix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which strings of SPAN bytes of some surroundings stand there twice.

    matrix: bytes of each from GRAM before its anchor to SPAN behind it; lo, hi:
    first and last start, from 0 to GRAM. Returns flags by row and start.
    """
    n = len(matrix)
    flags = np.zeros((n, GRAM + 1), bool)
    per = matrix.shape[1] // BLOCK
    first = -(-lo // BLOCK)
    past = (hi + SPAN) // BLOCK
    whole = (np.arange(per) >= first[:, None]) & (np.arange(per) < past[:, None])
    blocks = mix((BYTE_VALUES[matrix.reshape(n, per, BLOCK)[whole]] * powers(BLOCK)).sum(1, dtype=np.uint64))
    names = np.zeros((n, per), np.int64)
    names[whole] = np.unique(blocks, return_inverse=True)[1] + n + 1
    # each surroundings ends in a symbol of its own
    text = np.concatenate((names, np.arange(1, n + 1)[:, None]), axis=1).ravel()
    keep = np.concatenate((whole, np.ones((n, 1), bool)), axis=1).ravel()
    where = np.flatnonzero(keep)
    text = text[where]
    order = suffix_array(text)
    padded = np.concatenate((text, np.zeros(BLOCKS, np.int64)))
    same = np.ones(len(order) - 1, bool)
    for k in range(BLOCKS):
        a, b = padded[order[:-1] + k], padded[order[1:] + k]
        same &= (a == b) & (a > n)
    # runs of suffixes that share BLOCKS symbols
    runs = np.concatenate(([0], np.cumsum(~same)))
    size = np.bincount(runs)
    of_run = size[runs] > 1
    suffix = where[order[of_run]]
    run = runs[of_run]
    row, block = suffix // (per + 1), suffix % (per + 1)
    if not len(row):
        return flags
    # exact: the strings whose first whole block is this one, by their bytes
    shift = np.arange(BLOCK)
    start = block[:, None] * BLOCK - shift
    valid = (start >= lo[row][:, None]) & (start <= hi[row][:, None])
    e, s = np.nonzero(valid)
    start = start[e, s]
    prefix = np.zeros((n, matrix.shape[1] + 1), np.uint64)
    np.cumsum(BYTE_VALUES[matrix] * powers(matrix.shape[1]), axis=1, out=prefix[:, 1:])
    r = row[e]
    h = mix((prefix[r, start + SPAN] - prefix[r, start]) * powers(matrix.shape[1], "down")[start]) ^ mix(run[e].astype(np.uint64) * np.uint64(64) + s.astype(np.uint64))
    o = np.argsort(h, kind="stable")
    h, r, start = h[o], r[o], start[o]
    twice = np.zeros(len(h), bool)
    equal = h[1:] == h[:-1]
    near = np.flatnonzero(equal)
    for a in range(0, len(near), 20_000):  # their bytes are compared
        k = near[a : a + 20_000]
        left, right = (matrix[r[x][:, None], start[x][:, None] + np.arange(SPAN)] for x in (k, k + 1))
        equal[k] = (left == right).all(1)
    twice[1:] |= equal
    twice[:-1] |= equal
    flags[r[twice], start[twice]] = True
    return flags


def _settled(at_once: int):
    """Rows sorted by (key, around): intervals (text_id, lo, hi) of starts of repeated strings, of surroundings that are alone."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(t: pa.Table) -> pa.RecordBatch:
            key, around = t.column("key").to_numpy(), t.column("around").to_numpy()
            p, lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("p", "lo", "hi"))
            ids, alone = t.column("text_id").to_numpy(), t.column("alone").to_numpy(zero_copy_only=False)
            new_key = np.diff(key, prepend=~key[:1]) != 0
            new = new_key | (np.diff(around, prepend=~around[:1]) != 0)
            column = t.column("bytes").combine_chunks() if isinstance(t.column("bytes"), pa.ChunkedArray) else t.column("bytes")
            new[1:] |= ~pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            whole = np.diff(at, append=len(key))[run] > 1
            out = [(ids[whole & alone], lo[whole & alone], hi[whole & alone])]
            kept = at[(np.bincount((np.cumsum(new_key) - 1)[at]) > 1)[(np.cumsum(new_key) - 1)[at]]]
            if len(kept):
                data, off = buffers(t.column("bytes"))
                matrix = np.zeros((len(kept), GRAM + SPAN), np.uint8)
                for k, i in enumerate(kept.tolist()):
                    a = lo[i] - (p[i] - GRAM)
                    matrix[k, a : a + off[i + 1] - off[i]] = data[off[i] : off[i + 1]]
                base = p[kept] - GRAM
                flags = repeated(matrix, lo[kept] - base, hi[kept] - base)
                edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                r, a = np.nonzero(edge == 1)
                _, b = np.nonzero(edge == -1)
                out.append((ids[kept][r], base[r] + a, base[r] + b - 1))
            x, a, b = (np.concatenate(c) for c in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["text_id", "lo", "hi"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= at_once:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut:
                    yield solved(t.slice(0, cut).combine_chunks())
                    t = t.slice(cut)
                held, size = t.to_batches(), t.num_rows
        if size:
            yield solved(pa.Table.from_batches(held).combine_chunks())

    return f


#: A second random value for each byte.
OTHER_VALUES = mix(BYTE_VALUES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _cut: two hashes for each string of SPAN bytes, with its start."""
    for batch in batches:
        data, at = buffers(batch.column("bytes"))
        prefix = prefix_hashes(data[: at[-1]])
        lo, hi = batch.column("lo").to_numpy().astype(np.int64), batch.column("hi").to_numpy().astype(np.int64)
        count = hi - lo + 1
        row = np.repeat(np.arange(len(lo)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = at[row] + step
        h = span_hashes(prefix, start, start + SPAN)
        other = np.zeros(len(prefix), np.uint64)
        np.cumsum(OTHER_VALUES[data[: at[-1]]] * powers(len(prefix) - 1), out=other[1:])
        h2 = span_hashes(other, start, start + SPAN)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(batch.column("text_id").to_numpy()[row]), pa.array(lo[row] + step)], ["h", "h2", "text_id", "lo"])


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = buffers(batch.column("text"))
        copied = batch.column("copied").to_pylist()
        spans = batch.column("spans").to_pylist()
        kept, n_spans = [], []
        for k in range(batch.num_rows):
            text = data[at[k] : at[k + 1]]
            if copied[k] and len(text) >= SPAN:
                kept.append(b"")
                n_spans.append(1)
            elif spans[k]:
                s = np.array([(x["lo"], x["hi"] + SPAN) for x in spans[k]], np.int64)
                s = s[np.argsort(s[:, 0], kind="stable")]
                past = np.maximum.accumulate(s[:, 1])
                new = np.flatnonzero(np.concatenate(([True], s[1:, 0] > past[:-1])))
                begin, end = s[new, 0], past[np.append(new[1:], len(s)) - 1]
                pieces = zip([0, *end.tolist()], [*begin.tolist(), len(text)])
                kept.append(b"".join([text[x:y].tobytes() for x, y in pieces]))
                n_spans.append(len(new))
            else:
                kept.append(text.tobytes())
                n_spans.append(0)
        names = [x for x in batch.schema.names if x not in ("copied", "spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], [*names, "n_spans", "kept"])


#: Texts whose first hash is that of another text, at most; of 10 ** 10 texts some three have one.
CLASHES = 10_000


def _named(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Hashes of texts that are there more than once, and what adds a text's hash: of 64 bits, or where two texts share these, of both hashes."""
    body = F.coalesce("text", F.lit(""))
    both = docs.select(F.xxhash64(body).alias("text_id"), F.xxhash64(F.lit(4), body).alias("h2"))
    seen = stored(both.groupBy("text_id", "h2").agg(F.count("*").alias("n")).groupBy("text_id").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where("n > 1"))
    clashes = [x.text_id for x in seen.where("texts > 1").select("text_id").limit(CLASHES + 1).collect()]
    if len(clashes) > CLASHES:
        raise ValueError("too many texts share a hash")

    def named(df: DataFrame, text: str) -> DataFrame:
        of = F.coalesce(text, F.lit(""))
        first = F.xxhash64(of)
        return df.withColumn("text_id", F.when(first.isin(clashes), F.xxhash64(first, F.xxhash64(F.lit(4), of))).otherwise(first) if clashes else first)

    if clashes:
        seen = stored(named(docs.select("text"), "text").groupBy("text_id").agg(F.count("*").alias("n")).where("n > 1"))
    return seen.select("text_id"), named


def without_repeats(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (all by default; text among them) with n_bytes, n_removed, n_spans and kept (binary).

    Every byte covered by a string of SPAN bytes that also starts elsewhere in
    any text, or in the same one, is removed; strings are judged on the input
    and never cross texts. A null text is empty; repeated rows are each other's
    copies, so both lose all; an empty table gives no rows. Columns with the new
    names are replaced, others pass through whatever their names. Long texts are
    looked at in pieces.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    names = [c for c in (columns or docs.columns) if c not in new]
    # names of their own while they pass through, and the text's
    rows = docs.select(*(F.col(c).alias("text" if c == "text" else f"_{i}_{c}") for i, c in enumerate(names)))
    copies, named = _named(docs)
    text = named(docs.select(F.coalesce("text", F.lit("")).alias("text")), "text")
    few = copies.count() <= BROADCAST_ROWS
    copied = F.broadcast(copies) if few else copies
    # of equal texts one takes part below; all of them are repeats as a whole
    single = text.join(copied, "text_id", "left_anti")
    one = text.join(copied, "text_id", "left_semi").dropDuplicates(["text_id"])
    texts = single.unionByName(one)
    found = by_arrow(texts.select("text_id", "text"), _anchored(PIECE, SPREAD), ANCHORS)
    met = stored(by_arrow(found.repartition("route").sortWithinPartitions("route", "around", "again"), _met, "anchor long, text_id long, p int, lo int, hi int, mixed boolean"))
    spark = docs.sparkSession
    released(spark)
    mixed = met.where("mixed is not null")
    crowded = stored(mixed.groupBy("anchor").count().where(F.col("count") > GROUP_LIMIT).select("anchor"))
    hot = crowded.limit(1).count() > 0

    def surroundings(marks: DataFrame) -> DataFrame:
        of_text = marks.groupBy("text_id").agg(F.collect_list(F.struct("anchor", "text_id", "p", "lo", "hi", "mixed")).alias("marks"))
        return by_arrow(texts.join(of_text, "text_id").select("text", "marks"), _cut, "key long, around long, text_id long, p int, lo int, hi int, alone boolean, bytes binary")

    calm = mixed.join(crowded, "anchor", "left_anti") if hot else mixed
    dealt = surroundings(calm).repartition("key").sortWithinPartitions("key", "around")
    settled = stored(by_arrow(dealt, _settled(SORTED_AT_ONCE), "text_id long, lo long, hi long"))
    released(spark)
    spans = met.where("mixed is null").select("text_id", F.col("lo").cast("long"), F.col("hi").cast("long")).unionByName(settled)
    if hot:
        strings = by_arrow(surroundings(mixed.join(crowded, "anchor", "left_semi")), _hashed, "h long, h2 long, text_id long, lo long")
        again = strings.groupBy("h", "h2").count().where("count > 1").select("h", "h2")
        spans = spans.unionByName(stored(strings.join(again, ["h", "h2"]).select("text_id", "lo", F.col("lo").alias("hi"))))
        released(spark)
    of_text = spans.distinct().groupBy("text_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = named(rows, "text").join(copied.select("text_id", F.lit(True).alias("copied")), "text_id", "left").join(of_text, "text_id", "left").drop("text_id")
    schema = StructType([*(f for f in rows.schema.fields if f.name not in ("copied", "spans")), StructField("n_spans", LongType()), StructField("kept", BinaryType())])
    out = by_arrow(rows, _stripped, schema)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    passed = [F.col("text") if c == "text" else F.col(f"_{i}_{c}").alias(c) for i, c in enumerate(names)]
    return out.select(*passed, size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), "n_spans", "kept")


def stripped(docs: DataFrame) -> DataFrame:
    """docs with each text less its repeats; bytes of a character that was cut in two go as well. n_chars, if there, is counted anew.

    A null text stays null; equal texts of SPAN bytes or more all become empty;
    an empty table gives none; other columns keep their values, whatever their
    names.
    """
    taken = {"n_spans", "kept", "n_bytes", "n_removed"}
    clash = {c: f"_kept_{c}" for c in docs.columns if c in taken}
    out = without_repeats(docs.withColumnsRenamed(clash)).withColumn("text", F.when(F.col("text").isNotNull(), whole_characters("kept")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.drop(*taken).withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def whole_characters(column: str):
    """Binary to text without the bytes that aren't valid UTF-8."""
    text = F.expr(f"try_validate_utf8(cast({column} as string))")
    return F.coalesce(text, F.regexp_replace(F.expr(f"make_valid_utf8(cast({column} as string))"), "�", ""))
