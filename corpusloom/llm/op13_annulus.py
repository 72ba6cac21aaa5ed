"""Centroid clustering of integer vectors with an annulus search, exact throughout.

Centroids are sorted by norm. The distance to the one whose norm is nearest
bounds a vector's distance to its nearest one, and by the triangle inequality
only centroids whose norm differs by no more than that bound can be as near: two
binary searches give that annulus, and its members are compared exactly, those
on its edge too. Each round is one scan: tasks add up the vectors of each
centroid in whole numbers and hand on a row for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import by_arrow, ragged, stored

#: Components of a vector, by how much they are scaled, centroids, rounds, and the start's seed.
WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Components that are larger, once scaled, make squared distances that don't fit 64 bits.
LARGEST = 1 << 27
#: Vectors that are placed together, and pairs that are compared together.
BLOCK, PAIRS = 4_096, 1 << 14


class Annulus:
    """Centroids by norm, and the search among them."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.points = norms[self.order], centroids[self.order]
        #: Pairs that were compared.
        self.compared = 0

    def distances(self, x: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of x[rows] and the centroids at these places of the order."""
        out = np.empty(len(rows), np.int64)
        for a in range(0, len(rows), PAIRS):
            off = x[rows[a : a + PAIRS]] - self.points[at[a : a + PAIRS]]
            out[a : a + PAIRS] = np.einsum("ij,ij->i", off, off)
        self.compared += len(rows)
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector: number of the nearest centroid, the least where several are, and the squared distance."""
        n = len(x)
        size = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        above = np.clip(np.searchsorted(self.norms, size), 0, len(self.norms) - 1)
        below = np.maximum(above - 1, 0)
        guess = np.where(np.abs(self.norms[above] - size) < np.abs(self.norms[below] - size), above, below)
        bound = np.sqrt(self.distances(x, np.arange(n), guess).astype(np.float64))
        # wide enough for what rounding takes
        bound += 1e-3 + 1e-9 * (size + bound)
        first, end = np.searchsorted(self.norms, size - bound, "left"), np.searchsorted(self.norms, size + bound, "right")
        counts = end - first
        rows, at = np.repeat(np.arange(n), counts), ragged(first, counts)
        d = self.distances(x, rows, at)
        starts = np.cumsum(counts) - counts
        least = np.minimum.reduceat(d, starts) if n else np.zeros(0, np.int64)
        number = np.where(d == least[rows], self.order[at], len(self.order))
        return (np.minimum.reduceat(number, starts) if n else np.zeros(0, np.int64)), least


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _summed(centroids: np.ndarray):
    """For each centroid: its vectors in a task, and their sums by component."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annulus(centroids)
        k, width = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                x = _vectors(batch.column("x").slice(a, BLOCK), width)
                mine, _ = near.nearest(x)
                counts += np.bincount(mine, minlength=k)
                np.add.at(sums, mine, x)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return f


def _placed(centroids: np.ndarray):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annulus(centroids)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                b = batch.slice(a, BLOCK)
                mine, d = near.nearest(_vectors(b.column("x"), centroids.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(mine, pa.int32()), pa.array(d)], ["vec_id", "cluster", "distance"])

    return f


def whole_vectors(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """vec_id and x, whole numbers floor(SCALE * component), of vectors (vec_id, embedding) that can be clustered."""
    x = F.col("embedding").cast("array<double>")
    sound = (F.size("embedding") == width) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST / SCALE))
    return vectors.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform(x, lambda v: F.floor(v * SCALE).cast("int")).alias("x"))


def updated(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean, one without vectors as it is. The driver gets a number for each component of each centroid."""
    sums = by_arrow(rows, _summed(centroids), "cluster int, n long, sums array<long>")
    sums = sums.select("cluster", "n", F.posexplode("sums").alias("at", "v")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster, r.at] = int(r.v) // r.n
    return out


def clustered(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each row of vectors (vec_id, embedding) that has `width` finite components.

    Other rows are left out: null vectors and components, other lengths, and
    components beyond LARGEST / SCALE, whose distances would exceed 64 bits. The
    vectors whose "seed:vec_id" has the least SHA-256 are the start; of rows with
    one vec_id the lesser vector comes first, and rows without a vec_id come last.
    Fewer vectors than centroids make fewer centroids. Repeated rows are vectors
    of their own; an empty table gives no rows; other columns are ignored. A sum
    that exceeds 64 bits is null.
    """
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, width))
    start = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "vec_id", "x").limit(centroids)
    points = np.array([r.x for r in start.collect()], np.int64).reshape(-1, width)
    for _ in range(rounds if len(points) else 0):
        before, points = points, updated(rows, points)
        if (before == points).all():  # further rounds change nothing
            break
    if not len(points):
        points = np.zeros((1, width), np.int64)
    placed = stored(by_arrow(rows, _placed(points), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"))
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    total = sum(int(r.d) for r in sums)
    fits = lambda n: n if n < 1 << 63 else None
    named = [(r.cluster, fits(int(r.d)), fits(total), hashlib.sha256(",".join(map(str, points[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    # a row for each centroid
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(rounds: int = ROUNDS) -> str:
    """SQL that compares each vector with each centroid in every round."""
    d = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda r: f"(select r, k, d from (select r, k, {d} d, row_number() over (partition by r order by d, k) i from v, c{r}) where i = 1)"
    out = [f"""with v as materialized (
  select row_number() over () r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::double)::bigint) x from embeddings
  where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda e: isfinite(e) and abs(e::double) <= {LARGEST // SCALE})) = {WIDTH}),
c0 as materialized (select row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, vec_id, x) - 1 k, x y from v qualify k < {CENTROIDS})"""]
    for r in range(rounds):
        out.append(f"""a{r} as materialized {near(r)},
s{r} as (select k, i, sum(x[i]) s, count(*) n from a{r} join v using (r), range(1, {WIDTH + 1}) t(i) group by 1, 2),
m{r} as (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) y from s{r} group by 1),
c{r + 1} as materialized (select c.k, coalesce(m.y, c.y) y from c{r} c left join m{r} m using (k))""")
    out.append(f"a{rounds} as materialized {near(rounds)}")
    return ",\n".join(out) + f"""
select vec_id, k::int as "cluster", d::bigint distance, (sum(d) over (partition by k))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, sha256(array_to_string(y, ',')) centroid_sha256
from a{rounds} join v using (r) join c{rounds} using (k)
"""
