"""Searches look at a text once for each row, and count in the JVM."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import regexes, spans
from corpusloom.operators import search
from corpusloom.operators.search import Search
from tests.test_engine import corpus


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_matches_over_lines_are_found_once_a_row(spark):
    s = Search(r"\.\n[A-Z]", output_mode="content", multiline=True)
    plan = optimized(search.occurrences(corpus(spark, [("a", 1, "x.\nY")]), s))
    assert plan.count("regexp_extract_all(") == plan.count("regexp_replace(") == 1 and plan.count("split(") == 2


def test_touched_lines_find_matches_once_a_row(spark):
    c = corpus(spark, [("a", 1, "x.\nY.\nZ"), ("b", 2, ""), ("c", 3, "none")])
    found = search.touched_lines(search.occurrences(c, Search(r"\.\n[A-Z]", output_mode="content", multiline=True)))
    assert optimized(found).count("regexp_extract_all(") == 1
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, 1), ("a", 1, 2), ("a", 2, 2), ("a", 2, 3)]


@pytest.mark.parametrize("context", [0, 1])
def test_lines_are_split_and_matched_once_a_row(spark, context):
    c = corpus(spark, [("a", 1, "hit\nhit\n\n\nhit"), ("b", 2, ""), ("c", 3, "none")])
    found = search.matching_lines(c, Search("^h.t$", output_mode="content", context=context))
    assert optimized(found).count("split(") == 1
    rows = sorted((r.rel, r.line_no, r.line, r.is_match, r.block) for r in found.collect())
    hits = [("a", 1, "hit", True, 1), ("a", 2, "hit", True, 1), ("a", 5, "hit", True, 2)]
    assert rows == (hits if not context else [*hits[:2], ("a", 3, "", False, 1), ("a", 4, "", False, 1), ("a", 5, "hit", True, 1)])


TEXTS = ["", "th", "the ththx", "😀", "a😀th😀😀th", "th́ th", "\rth\r", "th", "aab aaa", "x th", " TH Th, 12 "]


@pytest.mark.parametrize("pattern, in_jvm", [("(th)*", True), ("a{0,2}", True), (r"\w*", True), ("[^a]*", True), (r"\b", True), ("$", True), ("x?|th", False), ("|th", False), ("(a|b)*", False), (".*?", False), ("(?x)a* # c", False)])
def test_empty_matches_are_counted_alike(spark, pattern, in_jvm):
    p = regexes.checked(spark, regexes.translated(pattern))
    rows = spark.createDataFrame([(x,) for x in TEXTS], "x string").select("x", spans.count_in_lines(F.array("x"), p).alias("n"))
    assert ("Python" not in rows._jdf.queryExecution().executedPlan().toString()) == in_jvm
    assert {r.x: r.n for r in rows.collect()} == {x: len(spans.spans_of(spans.python_pattern(p), x)) for x in TEXTS}


def test_long_lines_of_repeated_choices(spark):
    counted = search.counts(corpus(spark, [("a", 1, "ab" * 50_000)]), Search("(a|b)*", output_mode="count"))
    assert counted.first().occurrences == 1
