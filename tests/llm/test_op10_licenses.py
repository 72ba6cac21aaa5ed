"""Notices in lines of any length, and the SQL over texts that hold wrapped and one-line notices."""

import random

import duckdb

from corpusloom.llm import op10_licenses as op

GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
COMMON = sorted({w for t in op.TEMPLATES for w in t.split()})
COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def shuffled(seed, n):
    words = COMMON * (n // len(COMMON) + 1)
    random.Random(seed).shuffle(words)
    return " ".join(words[:n])


def texts():
    rng = random.Random(8)
    out = [GRANT, GRANT.replace("\n", " "), GRANT.replace("\n", "\r\n * "), "x " * 3000 + GRANT.replace("\n", " ") + " y" * 3000, shuffled(1, 960), shuffled(2, 4000), "", None, "\n\n"]
    for t in op.TEMPLATES:
        w = t.split()
        out += [t, "\n".join(w), f"{shuffled(3, 300)} {t.upper()} {shuffled(4, 300)}", " z ".join(w), " ".join(w[: len(w) // 2])]
    for _ in range(40):  # pieces of several notices in lines of every length
        parts = [" ".join(rng.choice(list(op.TEMPLATES)).split()[: rng.randrange(4, 30)]) for _ in range(rng.randrange(1, 6))]
        out.append("".join(p + rng.choice([" ", "\n", " of the ", "\n\n"]) for p in parts))
    return out


def test_a_notice_counts_alike_in_one_line_and_in_many(spark):
    docs = spark.createDataFrame(list(enumerate(texts()[:9])), "doc_id long, text string")
    got = {r.doc_id: r for r in op.licenses(docs).collect()}
    assert [got[k].labels for k in range(4)] == ["mit-text,mit-warranty"] * 4
    # common words of notices in one long line, in no order, are none
    assert all(got[k].labels == got[k].base_labels and got[k].score == 0 for k in (4, 5, 6, 7, 8))
    assert {(b.line, b.last_line, b.label) for b in got[1].blocks} == {(0, 0, "mit-text"), (0, 0, "mit-warranty")}
    assert {(b.line, b.last_line, b.label) for b in got[0].blocks} == {(0, 1, "mit-text"), (10, 11, "mit-warranty")}


def test_the_sql_knows_runs(spark):
    rows = list(enumerate(texts()))
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = {r[0]: r for r in con.execute(f"select {', '.join(COLUMNS)} from ({op.oracle_sql()})").fetchall()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r[:7] == want[k][:7] and abs(r[7] - want[k][7]) < 1e-9, (rows[k], r, want[k])
    assert sum(bool(r[6]) for r in got.values()) > 60
