"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors are one with a count. Each vector has a home cell, that of its
nearest centroid, and is a guest in cells of lower number whose bisecting
plane lies so near that a linked partner can be at home there; no pair is
lost. Neighbouring cells form a region; a vector goes once to each region that
holds a cell of its, with the list of these cells, so copies grow with regions
and not with cells. Within a cell products are taken in blocks, in single
precision first and where that comes near the threshold in double precision. A
large region is dealt in chunks. Blocks give counts of links and edges that span
components, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import by_arrow, groups, lists, stored
from corpusloom.llm.components import components

THRESHOLD = 0.98
#: Bytes of the vectors that centroids are fitted on at most (in single precision), the least of these for a cell, and rounds.
SAMPLE_BYTES, FITTED, ROUNDS = 32_000_000, 16, 8
#: Vectors of a label for each cell and for each region.
CELL, REGION = 2_048, 32_768
#: Rows of a region that are one chunk, and rows of a block.
CHUNK, BLOCK = 65_536, 1_024
#: By how much a product in single precision may be off.
SLACK = 1e-4


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit vectors; starts from vectors picked at random, and keeps an empty cell's centroid."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        at = np.searchsorted(near[order], np.arange(len(c)))
        some = np.flatnonzero(np.diff(at, append=len(x)))
        sums = np.add.reduceat(x[order], at[some], axis=0)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c[some] = np.where(size > 0, sums / np.where(size > 0, size, 1), c[some])
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_width(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of a list column, for each length."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    for width in np.unique(size).tolist():
        rows = np.flatnonzero(size == width)
        yield width, rows, flat[at[:-1][rows][:, None] + np.arange(width)]


def _placed(centroids: np.ndarray, region: np.ndarray, threshold: float):
    """A row for each region of a vector: its cells there, that at home first and marked by role 0."""
    apart = math.sqrt(2 - 2 * threshold) + 1e-9
    regions = int(region.max()) + 1

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                b = batch.slice(a, BLOCK)
                for width, rows, raw in _by_width(b.column("embedding")):
                    # a vector that is shorter than centroids has zeros behind its end
                    x = _unit(raw.astype(np.float64))
                    c = np.zeros((len(centroids), width))
                    wide = min(width, centroids.shape[1])
                    c[:, :wide] = centroids[:, :wide]
                    near = x @ c.T
                    home = near.argmax(1)
                    gap = np.sqrt(np.maximum(0, 2 - 2 * centroids[home] @ centroids.T))
                    # a partner at home in another cell lies within `apart`, and beyond the plane between both centroids
                    inside = (near[np.arange(len(x)), home][:, None] - near <= apart * gap + 1e-9) & (np.arange(len(centroids)) < home[:, None])
                    inside[np.arange(len(x)), home] = True
                    row, cell = np.nonzero(inside)
                    guest = (cell != home[row]).astype(np.int64)
                    order = np.lexsort((cell, guest, row * regions + region[cell]))
                    row, cell, guest = row[order], cell[order], guest[order]
                    key = row * regions + region[cell]
                    first = np.flatnonzero(np.diff(key, prepend=-1))
                    who = pa.array(rows[row[first]])
                    data = [v.tobytes() for v in raw]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("label").take(who), pa.array(region[cell[first]].astype(np.int32)), pa.array(guest[first].astype(np.int32)), b.column("node").take(who), b.column("copies").take(who),
                         lists(cell.astype(np.int32), np.diff(first, append=len(key)), pa.int32()), pa.array([data[r] for r in row[first].tolist()], pa.binary())],
                        ["label", "region", "role", "node", "copies", "cells", "vector"],
                    )

    return f


class _Links:
    """Links among the rows of a block of chunks: counts, and components as a forest."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, threshold: float):
        self.x, self.small = x, x.astype(np.float32)
        self.copies, self.threshold = copies, threshold
        self.links = np.zeros(len(x), np.int64)
        self.up = np.arange(len(x))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """Rows left against rows right; where a row is on both sides, each of its pairs is met twice and counted once."""
        both = np.zeros(len(self.x), bool)
        both[left] = True
        twice = both[right]
        for a in range(0, len(left), BLOCK):
            some = left[a : a + BLOCK]
            near = self.small[some] @ self.small[right].T >= self.threshold - SLACK
            near &= some[:, None] != right
            i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(i):
                continue
            u, v = some[i], right[j]
            near = near[np.ix_(i, j)] & (self.x[u] @ self.x[v].T >= self.threshold)
            self.links[u] += near @ self.copies[v]
            alone = ~twice[j]
            self.links[v[alone]] += self.copies[u] @ near[:, alone]
            while near.any():  # edges that span what isn't one component yet
                rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                edges = [*zip(u[rows].tolist(), v[near[rows].argmax(1)].tolist()), *zip(u[near[:, columns].argmax(0)].tolist(), v[columns].tolist())]
                for p, q in edges:
                    p, q = self.find(p), self.find(q)
                    self.up[max(p, q)] = min(p, q)
                root_u, root_v = (np.array([self.find(p) for p in side.tolist()]) for side in (u, v))
                near &= root_u[:, None] != root_v


def _blocks(threshold: float):
    """Rows sorted by (label, region, i, j): links of each vector in a block (copies counted) and the least node of its component there."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, i, j), t in groups(batches, ["label", "region", "i", "j"]):
            t = t.combine_chunks()
            ids, copies, side, role = (t.column(c).to_numpy() for c in ("node", "copies", "side", "role"))
            kind = np.float32 if t.column("single")[0].as_py() else np.float64
            x = _unit(np.frombuffer(b"".join(t.column("vector").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
            order = np.argsort(ids)  # so that the least row of a component is its least node
            back = np.empty(len(ids), np.int64)
            back[order] = np.arange(len(ids))
            links = _Links(x[order], copies[order], threshold)
            column = t.column("cells").combine_chunks()
            counts = np.diff(column.offsets.to_numpy())
            cell = column.flatten().to_numpy()
            row = np.repeat(np.arange(len(ids)), counts)
            begun = np.cumsum(counts) - counts
            home = np.zeros(len(cell), bool)
            home[begun[role == 0]] = True
            by_cell = np.argsort(cell, kind="stable")
            cuts = np.flatnonzero(np.diff(cell[by_cell], prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(cell))):
                m = by_cell[a:b]
                r, h, s = row[m], home[m], side[row[m]]
                if i == j:
                    links.compare(back[r[h]], back[r])
                else:
                    links.compare(back[r[h & (s == 0)]], back[r[s == 1]])
                    links.compare(back[r[~h & (s == 0)]], back[r[h & (s == 1)]])
            some = np.flatnonzero(links.links)
            root = np.array([links.find(k) for k in some.tolist()], np.int64)
            if len(some):
                ids = ids[order]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links.links[some]), pa.array(ids[root])], ["node", "links", "root"])

    return f


def vector_components(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Vectors of one label (of any type) and length link when their cosine is at
    least the threshold. Those without a label, or that are null, empty, zero or
    hold null or non-finite numbers, link with nothing. Repeated rows, and
    different vectors of one vec_id, are rows of their own and link with each
    other. A null vec_id has links, but its component is named by the least
    vec_id that isn't null, if any, and it is never kept. An empty table gives
    no rows; other columns are ignored. Centroids are fitted on at most about
    SAMPLE_BYTES of vectors, chosen by a hash; all vectors are placed, and cells
    are larger where the sample allows fewer.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    plain = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    sound = F.coalesce(F.col("label").isNotNull() & plain & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("sound", sound).withColumn("row", F.monotonically_increasing_id())
    # vectors of different lengths are of different labels
    rows = rows.withColumn("label", F.when(F.col("sound"), F.concat(F.size("embedding").cast("string"), F.lit(":"), F.col("label"))))
    rows = stored(rows.withColumn("h1", F.when(F.col("sound"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("sound"), F.xxhash64(F.lit(1), F.reverse("embedding")))))
    key = ["label", "h1", "h2"]
    classes = stored(rows.where("sound").groupBy(*key).agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("copies")))
    one = rows.where("sound").join(classes.select(F.col("node").alias("row"), "node", "copies"), "row").select("label", "node", "copies", "embedding")
    found = stored(_linked(one, single, threshold))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    joined = classes.join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    # a class is a row here, and a component's classes are summed before and after the shuffle
    names = joined.groupBy("root").agg(F.min("least").alias("name"))
    joined = stored(joined.join(names, "root").select(*key, "copies", F.coalesce("links", F.lit(0)).alias("links"), "name"))
    out = rows.join(joined, key, "left")
    return out.select(
        "vec_id",
        F.when(F.col("sound"), F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("sound"), F.col("name")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(one: DataFrame, single: bool, threshold: float) -> DataFrame:
    """(node, links, root) of distinct vectors."""
    width = F.size("embedding")
    x = one.groupBy("label").agg(F.count("*").alias("n"), F.max(width).alias("w")).agg(F.max("n").alias("n"), F.sum("n").alias("total"), F.max("w").alias("w")).first()
    n, total, wide = x.n or 0, x.total or 0, x.w or 1
    share = min(1.0, SAMPLE_BYTES / (4 * wide * max(1, total)))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("cells"), "node"), 11) / F.lit(float(1 << 53))
    sample = one.where(draw < share).select("embedding").toArrow().column(0).combine_chunks()
    fitted = [np.pad(_unit(v.astype(np.float64)), ((0, 0), (0, wide - w))) for w, _, v in _by_width(sample)] if len(sample) else []
    points = np.concatenate(fitted) if fitted else np.eye(1, wide)
    centroids = spherical_kmeans(points, int(min(max(1, len(points) // FITTED), -(-n // CELL) or 1)))
    # regions of cells, by the same means
    seeds = spherical_kmeans(centroids, int(min(len(centroids), -(-n // REGION) or 1)))
    region = (centroids @ seeds.T).argmax(1)
    placed = stored(by_arrow(one, _placed(centroids, region, threshold), "label string, region int, role int, node long, copies long, cells array<int>, vector binary"))
    # chunks: those at home first, then those of guests
    sizes = placed.groupBy("label", "region").agg((F.floor(F.count_if(F.col("role") == 0) / CHUNK) + 1).cast("int").alias("homes"), (F.ceil(F.count_if(F.col("role") == 1) / CHUNK)).cast("int").alias("guests"))
    # a region that fits one chunk takes its guests into it
    small = placed.groupBy("label", "region").count().where(F.col("count") <= CHUNK).select("label", "region", F.lit(True).alias("small"))
    sizes = sizes.join(small, ["label", "region"], "left").select("label", "region", "homes", F.when(F.col("small"), 0).otherwise(F.col("guests")).alias("guests"))
    spread = lambda k: F.pmod(F.xxhash64("node"), k).cast("int")
    own = F.when((F.col("role") == 0) | (F.col("guests") == 0), spread(F.col("homes"))).otherwise(F.col("homes") + spread(F.greatest("guests", F.lit(1))))
    dealt = placed.join(sizes, ["label", "region"]).withColumn("c", own)
    blank = F.array().cast("array<int>")
    all_ = F.col("homes") + F.col("guests")
    to = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(blank)
    home = (F.col("role") == 0) | (F.col("guests") == 0)
    as_left = F.when(home, F.transform(to(F.col("c"), all_ - 1), lambda j: F.struct(F.col("c").alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    as_right = F.transform(to(F.lit(0), F.when(home, F.col("c") - 1).otherwise(F.col("homes") - 1)), lambda i: F.struct(i.alias("i"), F.col("c").alias("j"), F.lit(1).alias("side")))
    struct = "array<struct<i:int,j:int,side:int>>"
    columns = ["node", "copies", "role", "cells", "vector"]
    dealt = dealt.select("label", "region", *columns, F.explode(F.concat(F.coalesce(as_left, F.array().cast(struct)), as_right)).alias("b")).select("label", "region", "b.*", *columns, F.lit(single).alias("single"))
    order = ["label", "region", "i", "j"]
    return by_arrow(dealt.repartition(*order).sortWithinPartitions(*order), _blocks(threshold), "node long, links long, root long")
