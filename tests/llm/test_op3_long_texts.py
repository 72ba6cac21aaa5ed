import random

import pytest

from corpusloom.llm import op3_quality

from . import brute


@pytest.mark.parametrize("n", [1_023, 1_024, 32_767, 32_768, 1_200_000])
def test_repeats_in_long_texts(spark, n):
    """Windows that differ aren't taken for equal, however many there are."""
    rng = random.Random(n)
    w = [f"{k:x}" for k in range(n)]
    for _ in range(20):
        a, b = rng.randrange(n - 5), rng.randrange(n - 5)
        w[a : a + 4] = w[b : b + 4]
    text = " ".join(w)
    rows = [(0, text, "s"), (1, " ".join(f"{k:x}" for k in range(n)), "s")]
    got = {r.doc_id: tuple(r)[1:] for r in op3_quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", *op3_quality.COUNTS).collect()}
    assert got == {k: brute.quality_counts(t) for k, t, _ in rows}
    assert got[0][-1] > 0 and got[1][-1] == 0
