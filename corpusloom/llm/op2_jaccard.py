"""N-gram Jaccard join by signature trees.

Texts become sets of word 5-gram hashes. Sets that are equal form a class, of
which only one takes part. A prefix filter under a global order (frequent
shingles last) deals the classes into blocks that hold every pair which can
reach the threshold; a block whose members are many is dealt into chunks. In
a block, a tree of signatures (OR-combined bitmaps, size ranges) is traversed
against itself: node pairs whose greatest possible overlap is too small, or
whose members are linked already, are pruned; what is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import BYTE_VALUES, Words, by_arrow, dropped, groups, lists, mix, parts_of_rows, released, stored
from corpusloom.llm.components import components

#: Threshold as a ratio of integers, and words in a shingle.
NUM, DEN, WORDS = 4, 5, 5
#: Shingles with more than 1 of 2 * HOT occurrences come last in the order; so there are at most 2 * HOT of them.
HOT = 500_000
#: Shingles (8 bytes each) and sets of a block's chunk, and shingles of a run of which frequent ones are counted.
CHUNK, CHUNK_SETS, COUNTED = 1_500_000, 256, 2_000_000
FANOUT = 8
#: Bytes of sets that a worker gives at once.
SHIPPED = 1 << 23
#: Prefixes are longer by a share of 1/LONGER, so that similar sets share as many of their keys.
LONGER = 20


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer than k words are one shingle, none an empty set."""
    w = Words(data, at)
    return _of_words(w.hashes, w.first, k)


def sets_of(column: pa.Array, k: int = WORDS) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, end row, sets) of a column; of a long text only the hashes of its words are held together."""
    held: list[np.ndarray] = []
    for a, b, data, at, first, last in parts_of_rows(column):
        if first and last:
            yield a, b, shingle_sets(data, at, k)
            continue
        held.append(Words(data, at).hashes)
        if last:
            words = np.concatenate(held)
            held = []
            yield a, b, _of_words(words, np.array([0, len(words)]), k)


def _of_words(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        rolled[: n - j] += hashes[j:] * (BYTE_VALUES[j] | np.uint64(1))
    rolled = mix(rolled)
    out = []
    first = first.tolist()
    for a, b in zip(first, first[1:]):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            part = hashes[a:b] * (BYTE_VALUES[: b - a] | np.uint64(1))
            out.append(mix(part.sum(dtype=np.uint64, keepdims=True) + BYTE_VALUES[100 + b - a : 101 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, as signed 64-bit integers."""
    if not len(s):
        return 0, 0
    x, y = mix(s), mix(s ^ BYTE_VALUES[9])
    sums = np.array([x.sum(dtype=np.uint64), np.bitwise_xor.reduce(x), y.sum(dtype=np.uint64), np.bitwise_xor.reduce(y)], np.uint64)
    both = mix(sums[[0, 2]] * BYTE_VALUES[7] + mix(sums[[1, 3]]) + np.uint64(len(s))).view(np.int64)
    return int(both[0]), int(both[1])


def _frequent(k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            x, n = np.unique(np.concatenate(held), return_counts=True)
            much = n >= max(2, size // HOT)
            return pa.RecordBatch.from_arrays([pa.array(x[much].view(np.int64)), pa.array(n[much].astype(np.int64)), pa.array(np.where(np.arange(much.sum()) == 0, size, 0).astype(np.int64))], ["h", "n", "total"])

        for batch in batches:
            for _, _, sets in sets_of(batch.column(0), k):
                held += sets
                size += sum(map(len, sets))
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    return f


def _signed(frequent: Broadcast, k: int):
    """For each document: n, set_id, and the prefix keys."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        for batch in batches:
            ids = batch.column(0)
            for a, b, sets in sets_of(batch.column(1), k):
                ns, names, keys = [], [], []
                for s in sets:
                    n = len(s)
                    ns.append(n)
                    names.append(set_id(s))
                    p = n - -(-NUM * n // DEN) + 1 + n // LONGER if n else 0
                    if len(hot) and n:
                        where = np.searchsorted(hot, s)
                        where[where == len(hot)] = 0
                        often = hot[where] == s
                        rare = s[~often]
                        s = rare if len(rare) >= p else np.concatenate((rare, s[often]))
                    keys.append(s[:p])
                flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(ns, pa.int64()), *(pa.array([x[i] for x in names], pa.int64()) for i in (0, 1)), lists(flat.view(np.int64), np.array([len(x) for x in keys]), pa.int64())], ["doc_id", "n_shingles", "set_id", "set_id2", "keys"])

    return f


def _shipped(names: list[str], k: int):
    """A row with its set for each place that a document goes to; to: a list of places, which have these names."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, to = batch.column("doc_id").to_pylist(), batch.column("to")
            at, places = to.offsets.to_numpy(), to.values
            fields = [places.field(n).to_numpy() for n in names]
            rows: list[tuple[int, int]] = []
            members: list[bytes] = []
            size = 0

            def made() -> pa.RecordBatch:
                place = np.array([p for _, p in rows], np.int64)
                return pa.RecordBatch.from_arrays([*(pa.array(x[place]) for x in fields), pa.array([ids[i] for i, _ in rows], pa.int64()), pa.array(members, pa.binary())], [*names, "doc_id", "members"])

            for a, _, sets in sets_of(batch.column("text"), k):
                for i, s in enumerate(sets, a):
                    data = s.tobytes()
                    for p in range(at[i], at[i + 1]):
                        rows.append((i, p))
                        members.append(data)
                        size += len(data)
                        if size >= SHIPPED:
                            yield made()
                            rows, members, size = [], [], 0
            if rows:
                yield made()

    return f


def shipped(text: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """places (doc_id and longs) with the set of each document: texts are joined once, by doc_id, and sets are made behind that."""
    names = [c for c in places.columns if c != "doc_id"]
    to = places.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("to"))  # at most as many as a document has prefix keys, times chunks
    joined = text.join(to.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "to")
    return by_arrow(joined, _shipped(names, k), ", ".join(f"{n} long" for n in names) + ", doc_id long, members binary")


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def labels(self) -> np.ndarray:
        up = self.up
        while (flat := up[up]).tolist() != up.tolist():
            up = flat
        self.up = up
        return up


class SignatureTree:
    """Levels of nodes over sets in the given order: bitmaps, least and greatest size, most bit collisions, common label."""

    def __init__(self, sets: list[np.ndarray], bits: int, labels: np.ndarray):
        n = len(sets)
        flags = np.zeros((n, bits), bool)
        size = np.array([len(s) for s in sets])
        flags[np.repeat(np.arange(n), size), (np.concatenate(sets) >> np.uint64(20)).astype(np.int64) & (bits - 1)] = True
        maps = np.packbits(flags, axis=1).view(np.uint64)
        spare = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, size, size, spare, labels)]
        while n > 1:
            cuts = np.arange(0, n, FANOUT)
            maps, lo, hi, spare, labels = self.levels[-1]
            same = np.minimum.reduceat(labels, cuts)
            same = np.where(same == np.maximum.reduceat(labels, cuts), same, -1)
            self.levels.append((np.bitwise_or.reduceat(maps, cuts, axis=0), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.maximum.reduceat(spare, cuts), same))
            n = len(cuts)


def traversed(x: SignatureTree, y: SignatureTree, mirrored: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that no bound excludes, of two trees, or of one tree against itself (i < j)."""
    top = max(len(x.levels), len(y.levels)) - 1

    def level(t: SignatureTree, d: int):
        return t.levels[min(d, len(t.levels) - 1)]

    def below(t: SignatureTree, d: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes i of level d at level d - 1: (index into i, child)."""
        if d > len(t.levels) - 1:
            return np.arange(len(i)), i
        n = len(t.levels[d - 1][1])
        child = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        of = np.repeat(np.arange(len(i)), FANOUT)
        return of[child < n], child[child < n]

    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        d, i, j = stack.pop()
        if len(i) > 4096:
            for a in range(0, len(i), 4096):
                stack.append((d, i[a : a + 4096], j[a : a + 4096]))
            continue
        (mi, lo_i, hi_i, c_i, l_i), (mj, lo_j, hi_j, c_j, l_j) = level(x, d), level(y, d)
        most = np.minimum(np.minimum(hi_i[i], hi_j[j]), np.bitwise_count(mi[i] & mj[j]).sum(1, dtype=np.int64) + np.minimum(c_i[i], c_j[j]))
        open_ = ((NUM + DEN) * most >= NUM * (lo_i[i] + lo_j[j])) & ((l_i[i] != l_j[j]) | (l_i[i] < 0))
        if mirrored:
            open_ &= (i < j) | ((i == j) & (d > 0))
        i, j = i[open_], j[open_]
        if not len(i):
            continue
        if not d:
            yield i, j
            continue
        of_i, ci = below(x, d, i)
        # each child of i against each child of its j
        of_j, cj = below(y, d, j[of_i])
        ci = ci[of_j]
        if mirrored:
            ci, cj = ci[ci <= cj], cj[ci <= cj]
        stack.append((d - 1, ci, cj))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test of two sorted distinct sets."""
    if len(a) > len(b):
        a, b = b, a
    if DEN * len(a) < NUM * len(b) or not len(a):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int(np.count_nonzero(b[at] == a))
    return DEN * common >= NUM * (len(a) + len(b) - common)


def _bits(sets: list[np.ndarray]) -> int:
    return int(min(4096, max(64, 1 << int(2 * sum(map(len, sets)) / len(sets)).bit_length())))


def linked(sets: list[np.ndarray], lead: int = 0) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that span the components of the sets, and a label for each; the set at lead is compared with all first."""
    order = sorted(range(len(sets)), key=lambda i: (i != lead, len(sets[i]), int(sets[i][0]) if len(sets[i]) else 0))
    sets = [sets[i] for i in order]
    forest, out = Forest(len(sets)), []
    for j in range(1, len(sets)):
        if similar(sets[0], sets[j]):
            forest.link(0, j)
            out.append((0, j))
    labels = forest.labels().copy()
    if (labels != 0).any():
        tree = SignatureTree(sets, _bits(sets), labels)
        for i, j in traversed(tree, tree, True):
            for a, b in zip(i.tolist(), j.tolist()):
                if forest.find(a) != forest.find(b) and similar(sets[a], sets[b]):
                    forest.link(a, b)
                    out.append((a, b))
    return [(order[a], order[b]) for a, b in out], forest.labels()[np.argsort(order)]


def linked_across(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between two lists of sets that span the components these links form."""
    bits = _bits(xs + ys)
    labels = np.arange(len(xs) + len(ys))
    forest, out = Forest(len(xs) + len(ys)), []
    for i, j in traversed(SignatureTree(xs, bits, labels[: len(xs)]), SignatureTree(ys, bits, labels[len(xs) :]), False):
        for a, b in zip(i.tolist(), j.tolist()):
            if forest.find(a) != forest.find(len(xs) + b) and similar(xs[a], ys[b]):
                forest.link(a, len(xs) + b)
                out.append((a, b))
    return out


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


#: An edge (u, v), or with v null a member u of a chunk of a block, with its set and whether it isn't linked to the block's lead.
SOLVED = "u long, v long, lead long, chunk long, far boolean, members binary"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lead, chunk, many, doc_id, members): SOLVED; where a block has many chunks, all members but its lead go on with their sets."""
    out: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        columns = list(zip(*out)) if out else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["u", "v", "lead", "chunk", "far", "members"])

    for (lead, chunk, many), t in groups(batches, ["lead", "chunk", "many"]):
        ids, raw = t.column("doc_id").to_pylist(), t.column("members").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in raw]
        at = ids.index(lead) if lead in ids else 0
        found, labels = linked(sets, at)
        out += [(ids[a], ids[b], None, None, None, None) for a, b in found]
        if many:  # the lead has met all chunks
            for i, x in enumerate(raw):
                if ids[i] != lead:
                    out.append((ids[i], None, lead, chunk, bool(labels[i] != labels[at] or ids[at] != lead), x))
                    size += len(x)
                    if size >= SHIPPED:
                        yield made()
                        out, size = [], 0
        if len(out) > 50_000:
            yield made()
            out, size = [], 0
    yield made()


def _solve_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lead, chunk, part, side, doc_id, members): edges between side 0 and side 1."""
    for _, t in groups(batches, ["lead", "chunk", "part"]):
        side, ids = t.column("side").to_pylist(), t.column("doc_id").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()]
        x, y = [i for i, s in enumerate(side) if s], [i for i, s in enumerate(side) if not s]
        if x and y:
            yield _edge_batch([(ids[x[a]], ids[y[b]]) for a, b in linked_across([sets[i] for i in x], [sets[i] for i in y])])


def jaccard_components(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Rows whose sets have Jaccard similarity of at least NUM/DEN are linked;
    component_id is the least doc_id reachable. A null or empty text has an
    empty set and is its own component. Equal sets, by two hashes of 64 bits and
    their size, are one class. Rows with one doc_id count as one document, so its
    texts are linked. A row without a doc_id gets the component of an equal set, or
    null. Repeated rows give repeated rows, an empty table none; other columns
    are ignored.
    """
    spark = docs.sparkSession
    text = docs.select("doc_id", "text")
    counts = by_arrow(text.select("text"), _frequent(k), "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    counts = stored(counts)
    total = counts.agg(F.sum("total")).first()[0] or 0
    # at most 2 * HOT values of 8 bytes, by the floor on n
    hot = np.sort(counts.where(F.col("n") >= max(2, total // (2 * HOT))).select("h").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
    dropped(counts)
    sig = stored(by_arrow(text, _signed(spark.sparkContext.broadcast(hot), k), "doc_id long, n_shingles long, set_id long, set_id2 long, keys array<long>"))
    same = ["set_id", "set_id2", "n_shingles"]
    # what is needed once prefix keys are dealt
    plain = stored(sig.select("doc_id", *same))
    # one document of each class of equal sets takes part; rows without a doc_id only belong to classes
    classes = stored(plain.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("doc_id")))
    # joined in one way at every size: nothing that grows with documents is broadcast
    one = stored(sig.join(classes.hint("shuffle_hash"), ["doc_id", *same], "left_semi").select("doc_id", "n_shingles", "keys"))
    dropped(sig)
    released(spark)
    keyed = one.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    # sizes of a linked pair differ by DEN/NUM at most, so both lie in one band of two neighbouring powers of it
    step = F.floor(F.log("n_shingles") / float(np.log(DEN / NUM)) + 1e-9)
    banded = keyed.join(shared.hint("shuffle_hash"), "key").select("key", "doc_id", "n_shingles", F.explode(F.array(step, step + 1)).alias("band"))
    leads = banded.groupBy("key", "band").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("top")).where("lead < top").select("key", "band", "lead")
    weights = banded.join(leads, ["key", "band"]).groupBy("doc_id", "n_shingles", "lead").agg(F.count("*").alias("w"))
    # Similar sets share at least as many prefix keys as the smaller one's prefix is longer. So a document that
    # shares fewer has no partner, and one may leave blocks that hold less than half of them: two documents
    # that both do still meet in another.
    least = 1 + F.floor(F.col("n_shingles") * NUM / (DEN * LONGER))
    of_doc = Window.partitionBy("doc_id")
    up_to = F.sum("w").over(of_doc.orderBy("w", "lead").rowsBetween(Window.unboundedPreceding, 0))
    weights = stored(weights.withColumn("c", up_to).withColumn("all", F.sum("w").over(of_doc)).where((F.col("all") >= least) & (F.col("c") * 2 > least - 1)).select("lead", "doc_id"))
    members = stored(weights.join(weights.groupBy("lead").count().where("count > 1").select("lead"), "lead", "left_semi"))
    dropped(one)
    dropped(weights)
    released(spark)
    sizes = plain.select("doc_id", F.col("n_shingles").alias("n")).where("doc_id is not null")
    chunks = F.floor(F.greatest(F.sum("n") / CHUNK, F.count("*") / CHUNK_SETS)) + 1
    blocks = stored(sizes.join(members.hint("shuffle_hash"), "doc_id").groupBy("lead").agg(chunks.alias("chunks")).where("chunks > 1"))
    own = F.pmod(F.xxhash64("doc_id"), "chunks")
    every = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    chunk = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("doc_id") == F.col("lead"), every).otherwise(F.array(own))
    places = members.join(blocks, "lead", "left").select("doc_id", "lead", F.explode(chunk).alias("chunk"), F.col("chunks").isNotNull().cast("long").alias("many"))
    dealt = shipped(text, places, k).repartition("lead", "chunk").sortWithinPartitions("lead", "chunk", "doc_id")
    edges = stored(by_arrow(dealt, _solve, SOLVED))
    released(spark)
    links = edges.where("v is not null").select("u", "v")
    far = edges.where("v is null and far").select("u", "lead", F.col("chunk").alias("part"), "members").join(blocks, "lead")
    if far.limit(1).count():
        # members that no chunk linked to their block's lead meet all its chunks; their sets are at hand
        parts = far.select("lead", "part").distinct()
        near = edges.where("v is null").join(parts, "lead").select("lead", "chunk", "part", F.lit(0).cast("long").alias("side"), F.col("u").alias("doc_id"), "members")
        cross = far.select("lead", F.explode(every).alias("chunk"), "part", F.lit(1).cast("long").alias("side"), F.col("u").alias("doc_id"), "members")
        order = ["lead", "chunk", "part"]
        sets = near.unionByName(cross).where("chunk <> part").repartition(*order).sortWithinPartitions(*order)
        across = stored(by_arrow(sets, _solve_across, "u long, v long"))
        released(spark)
        links = links.union(across.select("u", "v"))
    found = components(links).toDF("rep", "root")
    released(spark)
    for t in (members, blocks, edges):
        dropped(t)
    rows = plain.join(classes.withColumnRenamed("doc_id", "rep").hint("merge"), same, "left").join(found.hint("merge"), "rep", "left")
    # components() names a component by its least member, here its least doc_id
    return rows.select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id"))


def near_duplicates_removed(docs: DataFrame) -> DataFrame:
    """docs without the members of near-duplicate groups other than the one with the least doc_id.

    Of rows with one doc_id and text one stays. Rows without a doc_id stay, since
    none of them can be named. Texts without words (null, empty) are no
    duplicates; an empty table gives none; columns keep their values, whatever
    their names.
    """
    clash = {c: f"_kept_{c}" for c in docs.columns if c in ("n_shingles", "component_id", "n")}
    docs = docs.withColumnsRenamed(clash)
    found = jaccard_components(docs).where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_anti")
    repeated = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    if repeated.limit(1).count():
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns).withColumnsRenamed({v: k for k, v in clash.items()})
