import pickle
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.tokens import PrefixCounter, TokenCounter, line_totals
from corpusloom.operators import fit
from corpusloom.sources.corpus import table_corpus

#: A pattern of the kind that keeps case runs, contractions and line ends together.
CASES = r"[^\r\n\p{L}\p{N}]?[\p{Lu}]*[\p{Ll}]+(?:'s|'t)?|[^\r\n\p{L}\p{N}]?[\p{Lu}]+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
COUNTERS = {"bytes": TokenCounter(), "plain": TokenCounter(RANKS, public_tokenizers.PATTERN), "cases": TokenCounter(RANKS, CASES)}
PARTS = ["the ", "don't", "'", "s", " ", "  ", "\n", "\n\n", "\r\n", "\t", "fn main() {", "é", "\U0001f600", "12345", "CamelCase", "…", "}"]


def text_of(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


@pytest.mark.parametrize("name", COUNTERS)
def test_totals_of_lines_are_those_of_whole_prefixes(name):
    count, rng = COUNTERS[name], random.Random(4)
    for text in ["", "\n", "\n\n\n", " \n \n", "a", "a\n", "\n\nfoo", *(text_of(rng, rng.randrange(60)) for _ in range(120))]:
        ends = [i + 1 for i, c in enumerate(text) if c == "\n"] + ([len(text)] if text and not text.endswith("\n") else [])
        assert list(line_totals(text, count)) == [count(text[:e]) for e in ends]


@pytest.mark.parametrize("name", COUNTERS)
@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS), max_size=12), tail=st.sampled_from(["", "\n", "\n\n(note)", "s", " x"]))
def test_a_text_that_grows(name, parts, tail):
    count = COUNTERS[name]
    c = PrefixCounter(count)
    for k, p in enumerate(parts):
        c.push(p)
        assert c.total() == count("".join(parts[: k + 1]))
    assert c.total(tail) == count("".join(parts) + tail) and c.total() == count("".join(parts))


def test_counters_are_sent_by_their_ranks():
    again = pickle.loads(pickle.dumps(COUNTERS["plain"]))
    assert again("Hello, world\n") == COUNTERS["plain"]("Hello, world\n") and again.exact
    assert not pickle.loads(pickle.dumps(COUNTERS["bytes"])).exact


def test_token_lines_and_budgets_of_a_corpus(spark):
    rng, count = random.Random(9), COUNTERS["plain"]
    texts = {f"f{i}": text_of(rng, rng.randrange(80)) for i in range(40)} | {"empty": "", "none": None, "long": "a line of words\n" * 20_000}
    c = table_corpus(spark.createDataFrame([(k, v) for k, v in texts.items()], "k string, t string"), F.col("k"), F.lit(0), "t")
    got = {}
    for r in fit.token_lines(c, count).collect():
        got.setdefault(r.rel, {})[r.line_no] = r.tokens
    want = {k: dict(enumerate(line_totals(v, count), 1)) for k, v in texts.items() if v}
    assert got == want
    budget = 30
    found = {r.rel: (r.last_line, r.lines) for r in fit.token_budget(c, count, budget).collect()}
    for k, totals in want.items():
        over = [no for no, n in totals.items() if n > budget]
        assert found[k] == ((over[0] - 1 if over else len(totals)), len(totals))
    assert found.keys() == want.keys()


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_prefixes_within_a_budget(spark, monkeypatch, block):
    monkeypatch.setattr(fit, "BLOCK", block)
    rng = random.Random(block)
    rows = [(rng.choice(["a", "b", "c", None]), i * rng.choice([1, 1, 2]), rng.choice([0, 1, 5, 40, None])) for i in range(200)]
    rows = list({(k, n): (k, n, c) for k, n, c in rows}.values()) + [("first", 0, 1000), ("first", 1, 1), ("zero", 7, 0), ("gone", None, 3)]
    got = {r.k: (r.last, r.spent) for r in fit.budget_prefix(spark.createDataFrame(rows, "k string, n long, c long"), "k", "n", "c", 100).collect()}
    want = {}
    for k in {r[0] for r in rows if r[1] is not None}:
        spent, last = 0, None
        for n, c in sorted((n, c or 0) for key, n, c in rows if key == k and n is not None):
            if spent + c > 100:
                break
            spent, last = spent + c, n
        want[k] = (last, spent)
    assert got == want
    assert fit.budget_prefix(spark.createDataFrame([], "k string, n long, c long"), "k", "n", "c", 5).collect() == []
