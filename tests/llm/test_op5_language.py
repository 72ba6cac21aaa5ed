"""Languages against a plain model, word by word."""

import random
import re
import zlib
from collections import Counter, defaultdict
from math import exp, log

import pyarrow as pa
import pytest

from corpusloom.llm import op5_language as op

SCHEMA = "doc_id long, text string, lang string, lang_pred string, extra int"


def words(text):
    out = []
    for token in re.split(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""):
        out += [w for w in re.findall(r"[^\W\d_]+", token.lower()) if any(c.isalpha() for c in w)]
    return out


def grams(word, n):
    padded = word if n == 1 else f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Plain:
    def __init__(self, rows):
        self.langs = sorted({lang for _, lang in rows})
        self.counts = {k: defaultdict(Counter) for k in "w4321"}
        for text, lang in rows:
            for w in words(text):
                self.counts["w"][lang][w] += 1
                for n in (1, 2, 3, 4):
                    self.counts[str(n)][lang].update(grams(w, n))
        self.items = {k: {x for c in v.values() for x in c} for k, v in self.counts.items()}

    def log(self, kind, item, lang):
        c = self.counts[kind][lang]
        return log((c[item] + op.ADDED) / (sum(c.values()) + op.ADDED * (len(self.items[kind]) + 1)))

    def of(self, word, lang):
        if word in self.items["w"]:
            return self.log("w", word, lang)
        for n in op.LENGTHS:
            known = [g for g in grams(word, n) if g in self.items[str(n)]]
            if known:
                return op.BACKOFF * sum(self.log(str(n), g, lang) for g in known) / len(known)
        return 0.0

    def predict(self, text):
        w = words(text)
        if not w or not self.langs:
            return "und", 0.0
        total = [sum(self.of(x, lang) for x in w) for lang in self.langs]
        best = max(total)
        return self.langs[total.index(best)], 1 / sum(exp(max(-700, x - best)) for x in total)


def rows():
    rng = random.Random(6)
    parts = {"aa": ["ka", "ki", "ko", "Ta", "ti"], "bb": ["sch", "üng", "ein", "Ver", "ich"], "cc": ["que", "eau", "oir", "漢", "les"]}
    joins = [" ", " ", " ", "\n", ", ", "-", "’", "\xa0", "_", "2", "² ", "Σ "]

    def text(lang, n):
        return "".join("".join(rng.choice(parts[lang if rng.random() < 0.8 else rng.choice("abc") * 2]) for _ in range(rng.randint(1, 3))) + rng.choice(joins) for _ in range(n))

    out = [(k, text(lang, rng.choice([1, 3, 9, 30])), lang if k % 11 else None, "old", k) for k in range(240) for lang in [sorted(parts)[k % 3]]]
    out += [(500 + k, t, lang, None, None) for k, (t, lang) in enumerate([(None, "aa"), ("", "bb"), ("12 -- ² ½", "cc"), ("zzzz", None), ("語", None), ("ka" * 3000, None)])]
    return [*out, out[3]]


@pytest.mark.parametrize("slice_", [op.SLICE, 64])
def test_against_a_plain_model(spark, monkeypatch, slice_):
    monkeypatch.setattr(op, "SLICE", slice_)
    data = rows()
    plain = Plain([(t, lang) for i, t, lang, *_ in data if lang and zlib.crc32(str(i).encode()) % 3 != 1])
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    if slice_ == 64:  # in this process, where the smaller slices hold
        model = op.Model(plain.langs, *_arrays(plain))
        found, score = model.predict(pa.array([r[1] for r in data], pa.string()))
        got = list(zip(found, score.tolist()))
    else:
        out = op.languages(docs)
        assert set(out.columns) == {*docs.columns, "held_out", "score"}
        by_id = {r.doc_id: r for r in out.collect()}
        got = [(by_id[r[0]].lang_pred, by_id[r[0]].score) for r in data]
        assert all(by_id[r[0]].extra == r[4] for r in data)
    for r, (lang, score) in zip(data, got):
        want = plain.predict(r[1])
        assert score == pytest.approx(want[1], abs=1e-9)
        assert lang == want[0] or abs(score - 0.5) < 1e-9


def _arrays(plain):
    flat = [(w, plain.langs.index(lang), n) for lang, c in plain.counts["w"].items() for w, n in c.items()]
    import numpy as np

    return pa.array([x[0] for x in flat], pa.string()), np.array([x[1] for x in flat], np.int64), np.array([x[2] for x in flat], np.int64)


def test_ties_go_to_the_first_by_name(spark):
    data = [(k, "same words here", lang) for k, lang in zip([i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1], ["zz", "aa"] * 8)]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    out = op.languages(spark.createDataFrame([*data, (held, "same words", None)], "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in out} == {"aa"} and all(r.score == pytest.approx(0.5) for r in out)


def test_many_labels_are_sampled_by_row(spark):
    data = [(k, f"word{k}", f"l{k}") for k in range(400)]
    model = op.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), rows=40)
    assert 10 < len(model.langs) < 100
