import hashlib
import random
import zlib

import duckdb
import pytest

from corpusloom.llm import op11_trie as op

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long, up string, k long, _hot boolean, holders long"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])[:h] + v[h:]
    members, ends = {}, {}
    for c, v in made.items():
        ends.setdefault(tuple(v), []).append(c)
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for q in sorted(members, key=len, reverse=True):
        leaves[q] += not children[q]
        saved[q] += (len(members[q]) - 1) * len(q[-1][1]) if q else 0
        if q:
            for sums in (leaves, saved):
                sums[q[:-1]] += sums[q]
            children[q[:-1]] += 1
    digest = lambda q: hashlib.sha256(",".join(map(str, sorted(ends.get(q, [])))).encode()).hexdigest()
    return sorted((min(m), len(q), min(members[q[:-1]]) if q else None, len(m), children[q], leaves[q], saved[q], digest(q)) for q, m in members.items())


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "n", 1, "u", 2, True, 3) for r in rows], SCHEMA)
    return sorted(tuple(r[c] for c in COLUMNS) for r in op.prefix_trie(df).collect())


def odd_rows():
    rng = random.Random(3)
    text = lambda: rng.choice(["a", "é" * 3, "", None, "a\nb", "\U0001f600"])
    rows = [(c, t, rng.choice(["u", None, ""]), text()) for c in [*range(0, 9), *range(98, 130), *range(200, 330, 7), -5, -100, -203] for t in range(rng.randrange(1, 7))]
    rows += [(c, t, "u", "same") for c in range(400, 460) for t in range(3)]
    # turns without a number, equal ones, repeated rows, and rows of no conversation
    rows += [(330, None, "u", "x"), (330, None, "a", "y"), (330, None, "u", "x"), (330, 0, "u", "z"), (331, 1, "u", "x"), (331, 1, "u", "x"), (None, 1, "u", "x"), (None, None, None, None)]
    # the first of these 100 has fewer turns than the others take
    rows += [(500, 0, "u", "only")] + [(c, t, "u", f"{t}") for c in range(501, 520) for t in range(8)]
    # one that is long, and its like
    rows += [(c, t, "u", "t" * (t % 5) if t < 200 else f"{c}") for c in (600, 601) for t in range(201)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot, chunk", [(0.001, 1 << 20), (0.05, 1), (0.9, 8)])
def test_nodes_of_odd_conversations(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(op, "HOT", hot)
    monkeypatch.setattr(op, "CHUNK", chunk)
    rows = odd_rows()
    assert trie(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "u", "x")]) == []
    for rows in ([(0, 0, "u", "x")], [(1, 0, "u", "x")], [(3, None, None, None)], [(0, 0, "u", "x"), (7, 0, "u", "y")]):
        assert trie(spark, rows) == brute(rows)


def test_the_sql_knows_the_same_nodes(spark):
    rows = odd_rows()
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = con.execute(f"select {', '.join(COLUMNS)} from ({op.ORACLE})").fetchall()
    assert sorted(found) == brute(rows)


def test_a_list_of_ends_that_spans_ranges(spark):
    ids = list(range(1000, 9000))
    ends = spark.createDataFrame([(b"n" if i % 10 else bytes([i % 256, 1]), i) for i in ids], "node binary, conv_id long").repartition(5)
    got = {bytes(r.node): r.hash for r in op.ends_hashed(ends).collect()}
    want = {}
    for i in ids:
        want.setdefault(b"n" if i % 10 else bytes([i % 256, 1]), []).append(i)
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_parts_of_lists_of_any_cut(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(op, "CHUNK", 12)
    rows = [(bytes([n]), i) for n, many in enumerate((1, 2, 40, 1, 7, 30)) for i in range(n * 3, n * 3 + many)]
    made = []
    for part in (rows[:20], rows[20:45], rows[45:]):  # ranges begin and end inside a node's list
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part[a : a + size]], pa.binary()), pa.array([r[1] for r in part[a : a + size]])], ["node", "conv_id"]) for a in range(0, len(part), size)]
        made += [r for b in op._ends(iter(batches)) for r in b.to_pylist()]
    parts = sorted((r for r in made if r["hash"] is None), key=lambda r: (r["node"], r["first"]))
    table = pa.RecordBatch.from_arrays([pa.array([r[c] for r in parts], k) for c, k in (("node", pa.binary()), ("first", pa.int64()), ("part", pa.binary()))], ["node", "first", "part"])
    got = {r["node"]: r["hash"] for r in made if r["hash"]} | {r["node"]: r["hash"] for b in op._digested(iter([table])) for r in b.to_pylist()}
    assert got == {n: hashlib.sha256(",".join(str(i) for m, i in rows if m == n).encode()).hexdigest() for n in {r[0] for r in rows}}
    assert max(len(r["part"]) for r in parts) < 40 or size == 1000
