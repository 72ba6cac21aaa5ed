"""Katz scores against a plain model that evaluates token by token, with Good-Turing factors of its own."""

import random
import zlib
from collections import Counter, defaultdict
from math import log10

import pytest

from corpusloom.llm import common
from corpusloom.llm import op6_katz as op

from . import brute


def factors(counts, k=5):
    """d[1..k] of Katz (1987); one absolute discount where these aren't between 0 and 1."""
    n = Counter(counts)
    share = (k + 1) * n[k + 1] / n[1] if n[1] else 1
    if share < 1 and all(n[r] for r in range(1, k + 2)):
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) for r in range(1, k + 1)}
        if all(0 < x < 1 for x in d.values()):
            return d
    b = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
    return {r: (r - b) / r for r in range(1, k + 1)}


class Plain:
    def __init__(self, lists):
        train = [w for d, w in lists if zlib.crc32(str(d).encode()) % 10]
        self.c = Counter(x for w in train for x in w)
        self.pairs = Counter(p for w in train for p in zip(["<s>", *w], w))
        self.total, self.size = sum(self.c.values()), len(self.c)
        self.d1, self.d2 = factors(self.c.values()), factors(self.pairs.values())
        self.context = {**self.c, "<s>": len(train)}
        self.after = defaultdict(list)
        for h, w in self.pairs:
            self.after[h].append(w)
        self.free = 1 - sum(n * self.d1.get(n, 1) / (self.total + 0.5) for n in self.c.values())
        self.alpha = {}

    def p(self, w, *context):
        """Evaluated recursively: with a context, then without."""
        if not context:
            return self.c[w] * self.d1.get(self.c[w], 1) / (self.total + 0.5) if self.c[w] else self.free
        (h,) = context
        n = self.pairs[h, w]
        if n:
            return n * self.d2.get(n, 1) / (self.context[h] + 0.5)
        if h not in self.after:
            return self.p(w)
        if h not in self.alpha:
            self.alpha[h] = (1 - sum(self.p(x, h) for x in self.after[h])) / (1 - sum(self.p(x) for x in self.after[h]))
        return self.alpha[h] * self.p(w)

    def base(self, w):
        return sum(log10((self.c[x] + 0.1) / (self.total + 0.1 * (self.size + 1))) for x in w)


def check(spark, rows):
    lists = [(d, [*brute.words(t), "</s>"]) for d, t in rows]
    plain = Plain(lists)
    got = defaultdict(list)
    for r in op.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for d, w in lists:
        for r in got[d]:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in plain.c for x in w), plain.total)
            assert r.base_score == pytest.approx(plain.base(w))
            assert r.score == pytest.approx(sum(log10(plain.p(x, h)) for h, x in zip(["<s>", *w], w)))
    return plain


def test_every_distribution_sums_to_one():
    lists = [(r[0], [*brute.words(r[1]), "</s>"]) for r in brute.documents()]
    plain = Plain(lists)
    for h in [*plain.after, "never seen"]:
        assert sum(plain.p(w, h) for w in plain.c) + plain.p("an unknown word", h) == pytest.approx(1)


# runs of few tokens; frequent words and pairs; long texts
@pytest.mark.parametrize("limits", [{}, {"RUN_TOKENS": 500}, {"HOT_LEAST": 3, "HOT_WORDS": 60, "HOT_PAIRS": 200}, {"HOT_LEAST": 1, "HOT_WORDS": 10_000, "HOT_PAIRS": 10_000, "RUN_TOKENS": 300}])
def test_against_a_plain_model(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(op, k, v)
    check(spark, [(r[0], r[1]) for r in brute.documents()])


def test_frequent_words_and_pairs_of_all_counts(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(d, " ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(30))) for d in range(60)]
    rows += [(100 + d, "the end " * rng.randint(1, 40)) for d in range(40)]
    for least in (10**6, 2):
        monkeypatch.setattr(op, "HOT_LEAST", least)
        plain = check(spark, rows)
    assert sum(n == 1 for n in plain.pairs.values()) > len(plain.pairs) / 4


def test_long_texts_are_scored_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: f"{rng.choice('abcdef')}{rng.randrange(300)}"
    long = " ".join(word() for _ in range(500_000))
    rows = [(d, " ".join(word() for _ in range(40))) for d in range(20)]
    held = next(d for d in range(100, 200) if zlib.crc32(str(d).encode()) % 10 == 0)
    rows += [(50, long), (51, long), (held, long[len(long) // 3 :]), (60, long[-common.SLICE_BYTES - 5 :] + "   \n")]
    check(spark, rows)


def test_nothing_to_learn_from(spark):
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0]
    rows = [(held[0], "some words"), (held[1], None), (held[1], "")]
    assert {r.score for r in op.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0.0}
    assert op.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = op.scored(spark.createDataFrame([(None, "a b", 1, "x"), (None, "a b", 2, "y")], "doc_id long, text string, part long, run string")).collect()
    assert len(one) == 2 and all(not r.held_out and r.n_known == 3 for r in one)
