"""Prefix trie of conversations: digest-keyed edges and a rollup by pointer jumping.

A node is a sequence of first turns, known by 128 bits: the running sums of four
hashes of (turn, place), taken in two passes over ranges so that a conversation
of any length is dealt over tasks. Each row of a conversation names its node and
the node's parent; grouping by node gives members and edges. The rollup doubles:
a node points at its ancestor 2**j above, hands it what it has gathered, and
then points where that one points; after log2(depth) rounds every node has the
sums of its subtree. What many nodes point at is looked up in a broadcast of at
most a thousand rows, all else by joins on keys that are no longer hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import by_arrow, dropped, groups, stored
from corpusloom.operators.scan import differs, running

#: How many conversations share a template, the first of which lends its first turns, and how many at most, less one.
FAMILY, LENT = 100, 6
#: A pointer that more than this share of all nodes hold is looked up by broadcast: fewer than 1 / HOT are.
HOT = 0.001
#: Bytes of joined conv_ids that are one row, and characters of a role by which its rows are ranged.
CHUNK, HEAD = 1 << 20, 16

_LANES = [f"s{i}" for i in range(4)]


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, k, digest, chars of each turn, k counted from 1; rows without a conv_id are none."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.select("*", F.substring("role", 1, HEAD).alias("head0"), F.char_length("text").cast("long").alias("chars"), F.lit(1).alias("one"))
    # heads sort as whole roles do, and only they are sampled for the ranges
    done = running(rows, ["conv_id"], ["turn", "head0", "role", "text"], {"k": "one"}, ["conv_id", "turn", "head0"])
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return done.select("conv_id", "k", F.unhex(digest).alias("digest"), "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, chars) of all turns once templates are lent, and (conv_id, depth) with the length of each conversation, none left out.

    A conversation c takes the first h turns of the one at c - c % FAMILY (the
    remainder has the sign of c), h = crc32(c in decimal) % LENT, and goes on with its own behind its first h.
    """
    lent = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("k") < LENT))
    known = heads.groupBy("conv_id").agg(F.max("k").alias("has")).withColumnRenamed("conv_id", "lender")
    convs = turns.groupBy("conv_id").agg(F.max("k").alias("n")).withColumn("h", lent).withColumn("lender", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = convs.join(known, "lender", "left").withColumn("takes", F.least("h", F.coalesce("has", F.lit(0))))
    convs = stored(convs.select("conv_id", "lender", "n", "h", "takes", (F.col("takes") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth")))
    # at most FAMILY conversations (twice as many around 0) take each of LENT - 1 turns
    first = convs.join(heads.withColumnRenamed("conv_id", "lender"), "lender").where("k <= takes").select("conv_id", F.col("k").alias("depth"), "digest", "chars")
    # a conversation's own turns are many, so what it takes is added to them by the number that crc32 gives, and by the few that take less
    short = convs.where("takes < h").select(F.col("conv_id").alias("node"), F.col("n").alias("holders"), (F.col("h") - F.col("takes")).alias("less"))
    own = looked_up(turns.where(F.col("k") > lent), short, "conv_id", ["less"], turns.count(), "k").select("conv_id", (F.col("k") - F.coalesce("less", F.lit(0))).alias("depth"), "digest", "chars")
    return first.unionByName(own), convs.select("conv_id", "depth")


def _named(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary")))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent (null below the root), chars for each (conv_id, depth, digest, chars)."""
    h = [F.xxhash64(F.lit(seed), "digest", "depth") for seed in (1, 2)]
    rows = turns.withColumn("h0", h[0]).withColumn("h1", h[1])
    # 32 bits each, so that sums stay within 64 bits for 2**31 turns
    parts = {"v0": F.shiftrightunsigned("h0", 32), "v1": F.col("h0").bitwiseAND(0xFFFFFFFF), "v2": F.shiftrightunsigned("h1", 32), "v3": F.col("h1").bitwiseAND(0xFFFFFFFF)}
    rows = rows.select("conv_id", "depth", "chars", *(v.alias(n) for n, v in parts.items()))
    done = running(rows, ["conv_id"], ["depth"], dict(zip(_LANES, parts)))
    node = _named(F.col("depth"), [F.col(s) for s in _LANES])
    parent = _named(F.col("depth") - 1, [F.col(s) - F.col(v) for s, v in zip(_LANES, parts)])
    return done.select("conv_id", "depth", node.alias("node"), parent.alias("parent"), "chars")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id), sorted: the hash of each node's list where the whole of it is surely here, else its parts in rows of about CHUNK bytes."""
    made: list[tuple] = []
    key, first, held, size, whole = None, None, [], 0, False

    def part() -> None:
        made.append((key, first, b",".join(held), None))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.ones(n, bool)
        new[1:] = differs(batch.column("node"))
        ids = batch.column("conv_id").to_numpy()
        cuts = [*np.flatnonzero(new).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            node = batch.column("node")[a].as_py()
            if node != key:
                if held:
                    if whole:
                        made.append((key, None, None, hashlib.sha256(b",".join(held)).hexdigest()))
                    else:
                        part()
                # the first node of a range may have begun in the one before
                whole = key is not None
                key, held, size = node, [], 0
            for i in range(a, b, 1 << 16):
                some = b",".join(b"%d" % x for x in ids[i : min(b, i + (1 << 16))].tolist())
                if not held:
                    first = int(ids[i])
                held.append(some)
                size += len(some)
                if size >= CHUNK:
                    part()
                    held, size, whole = [], 0, False
        if len(made) >= 4096 or sum(len(m[2] or b"") for m in made) > 4 * CHUNK:
            yield _rows(made)
            made.clear()
    if held:  # the last node may go on in the next range
        part()
    if made:
        yield _rows(made)


def _rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["node", "first", "part", "hash"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, first, part), sorted: the hash of each node's parts one behind the other. A part at a time is held."""
    key, h = None, None
    for batch in batches:
        for node, part in zip(batch.column("node").to_pylist(), batch.column("part")):
            if node != key:
                if h:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], ["node", "hash"])
                key, h = node, hashlib.sha256(part.as_py())
            else:
                h.update(b"," + part.as_py())
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], ["node", "hash"])


def ends_hashed(ends: DataFrame) -> DataFrame:
    """node, hash: SHA-256 of the conv_ids that end there, in order. A long list is dealt in ranges to be joined, and one task only hashes its joined parts."""
    rows = stored(by_arrow(ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id"), _ends, "node binary, first long, part binary, hash string"))
    parts = rows.where("hash is null").select("node", "first", "part").repartition("node").sortWithinPartitions("node", "first")
    return rows.where("hash is not null").select("node", "hash").unionByName(by_arrow(parts, _digested, "node binary, hash string"))


def looked_up(rows: DataFrame, of: DataFrame, pointer: str, values: list[str], n_rows: int, apart: str = "node") -> DataFrame:
    """rows joined with of (node, holders, values) where pointer = node, values left null where there is none.

    holders says how many rows point at a node. Those that more than HOT of all
    do are broadcast, at most 1 / HOT of them; other pointers are joined by key.
    apart: a column of many values and the pointer's type.
    """
    most = int(n_rows * HOT)
    hot, cold = of.where(F.col("holders") > most).select(F.col("node").alias(pointer), F.lit(True).alias("_hot"), *values), of.where(F.col("holders") <= most)
    near = rows.join(F.broadcast(hot.select(pointer, "_hot", *(F.col(v).alias(f"_{v}") for v in values))), pointer, "left")
    # rows that are done join with nothing, each by a key of its own
    key = F.when(F.col("_hot") | F.col(pointer).isNull(), F.col(apart)).otherwise(F.col(pointer))
    near = near.withColumn("_key", key).withColumn("_by_key", F.col("_hot").isNull() & F.col(pointer).isNotNull())
    far = cold.select(F.col("node").alias("_key"), F.lit(True).alias("_by_key"), *(F.col(v).alias(f"_c_{v}") for v in values))
    joined = near.join(far, ["_key", "_by_key"], "left")
    return joined.select(*rows.columns, *(F.coalesce(f"_{v}", f"_c_{v}").alias(v) for v in values))


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """node and sums of nodes (node, parent, sums), each summed over the node's subtree, in log2(depth) rounds of doubling."""
    now = stored(nodes.select("node", F.col("parent").alias("up"), *sums))
    n_rows = now.count()
    while now.where("up is not null").limit(1).count():
        # what nodes 2**j below have gathered; a hot ancestor's rows are summed before the shuffle
        got = now.where("up is not null").groupBy("up").agg(*(F.sum(s).alias(f"more_{s}") for s in sums), F.count("*").alias("holders")).withColumnRenamed("up", "node")
        now, before = now.join(got, "node", "left"), now
        now = now.select("node", "up", "holders", *(((F.col(s) + F.coalesce(F.col(f"more_{s}"), F.lit(0))).alias(s)) for s in sums))
        middle = stored(now)
        targets = middle.where("holders is not null").select("node", "holders", F.col("up").alias("next"))
        now = stored(looked_up(middle.drop("holders"), targets, "up", ["next"], n_rows).select("node", F.col("next").alias("up"), *sums))
        dropped(before)
        dropped(middle)
    return now.drop("up")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node of conversations (conv_id, turn, role, text).

    conv_id: the least member. A null role or text is empty; turns stand in order
    of turn, null first, and equal ones in order of role and text, so repeated
    rows are turns of their own. Rows without a conv_id take no part; a
    conversation that loses all its turns is a member of the root. An empty table
    gives no rows, not even a root; other columns are ignored. Texts of any length
    are known by their SHA-256.
    """
    turns = stored(turns_in_order(conversations))
    first, convs = rebuilt(turns)
    rows = stored(prefixes(first))
    root = _named(F.lit(0), [F.lit(0)] * 4)
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(root.alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("chars"))
    nodes = stored(nodes.unionByName(top))
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    nodes = stored(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    start = nodes.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = rolled_up(start, ["n_leaves", "saved_tokens"])
    parents = nodes.where("n_children > 0").select("node", F.col("n_children").alias("holders"), F.col("conv_id").alias("parent_conv_id"))
    named = looked_up(nodes, parents, "parent", ["parent_conv_id"], nodes.count())
    # a conversation ends where its last turn is, or at the root
    ends = rows.join(convs, ["conv_id", "depth"]).select("node", "conv_id").unionByName(convs.where("depth = 0").select(root.alias("node"), "conv_id"))
    out = named.join(sums, "node").join(ends_hashed(ends), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("hash", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: SQL of the same rows. crc32 is folded over a table of 256 remainders made from its polynomial.
ORACLE = f"""
with t0 as (select list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, i: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end)) t),
own as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) k, coalesce(role, '') role, coalesce(text, '') text from conversations where conv_id is not null),
c0 as (select conv_id, count(*) n from own group by 1),
c1 as (select conv_id, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1)))), lambda c, b: xor(t[(xor(c, b) % 256) + 1], c // 256))) % {LENT} h from c0, t0),
c2 as (select c.conv_id, h, c.n, c.conv_id - c.conv_id % {FAMILY} lender, least(h, coalesce(l.n, 0)) takes from c1 c left join c0 l on l.conv_id = c.conv_id - c.conv_id % {FAMILY}),
r as (select c.conv_id, k d, role, text from c2 c join own o on o.conv_id = c.lender and k <= takes union all select c.conv_id, k - h + takes, role, text from c2 c join own o using (conv_id) where k > h),
x as (select conv_id, list(sha256(length(role) || ':' || role || text) order by d) q, list(length(text) order by d) z from r group by 1),
y as (select conv_id, coalesce(q, []) q, coalesce(z, []) z from c2 left join x using (conv_id)),
p as (select conv_id, q, z, unnest(range(len(q) + 1)) d from y),
n0 as (select sha256(d || ',' || array_to_string(list_slice(q, 1, d), ',')) node, any_value(list_slice(q, 1, d)) q, any_value(d) d, min(conv_id) conv_id, count(*) n_convs, any_value(case when d > 0 then z[d] else 0 end) chars,
  coalesce(string_agg(case when len(q) = d then conv_id::varchar end, ',' order by conv_id), '') ends from p group by 1),
n1 as (select *, case when d > 0 then sha256((d - 1) || ',' || array_to_string(list_slice(q, 1, d - 1), ',')) end parent from n0),
ch as (select parent, count(*) n_children from n1 where parent is not null group by 1),
n2 as (select n1.*, coalesce(n_children, 0) n_children from n1 left join ch on ch.parent = n1.node),
a as (select unnest(list_transform(range(d + 1), lambda j: sha256(j || ',' || array_to_string(list_slice(q, 1, j), ',')))) node, n_children, n_convs, chars from n2),
s as (select node, count_if(n_children = 0) n_leaves, sum((n_convs - 1) * chars) saved from a group by 1)
select n.conv_id, n.d::bigint "depth", u.conv_id parent_conv_id, n.n_convs, n.n_children, n_leaves::bigint n_leaves, saved::bigint saved_tokens, sha256(n.ends) ends_sha256
from n2 n join s using (node) left join n2 u on u.node = n.parent
"""
