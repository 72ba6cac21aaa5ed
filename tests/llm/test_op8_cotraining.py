"""Scores of the fitted views against a plain version, word by word; what the views teach each other; odd input."""

import random
import re
import zlib
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm import op8_cotraining as op

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, quality_score string"
BASE, MASK = 0x5851F42D4C957F2D, (1 << 64) - 1


def bucket(word):
    h = sum(int(common.BYTE_VALUES[b]) * pow(BASE, k, 1 << 64) for k, b in enumerate(word)) & MASK
    h ^= h >> 29
    return ((h * 0xBF58476D1CE4E5B9) & MASK) >> 44


def plain(models, target, text, source, lang, size):
    m = models[target]
    data = text.encode()
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)
    low = [re.sub(rb"[A-Z]", lambda x: x[0].lower(), w) for w in words]
    seen = {bucket(w) for w in low}
    n, letters = len(words), sum(map(len, words))
    capitals = sum(65 <= b <= 90 for b in data)
    marks = sum(b not in b" \t\n\x0b\x0c\r" for b in data) - letters
    most, length = max(1, n), max(1, len(data))
    shape = [log1p(n) / 10, len(seen) / max(1, n**0.5 * 10), len(seen) / most, capitals / length, letters / length, marks / length, letters / most / 10]
    text_view, meta_view = m.views
    z = text_view.b + float(np.dot(shape, text_view.d)) + sum(text_view.w[m.known.table[b]] for b in seen if m.known.table[b] >= 0)
    for k, x in enumerate(shape):
        z += text_view.w[m.known.words + k * op.BINS + min(op.BINS - 1, int(x * op.BINS))]
    meta = [f"s:{source}", f"l:{lang}", f"n:{(size or 0).bit_length()}"]
    y = meta_view.b + sum(meta_view.w[zlib.crc32(x.encode()) % op.META] for x in meta)
    prior = log(m.prior / (1 - m.prior))
    total = prior + sum(a * v + b - prior for (a, b), v in zip(m.fits, (z, y)))
    return 1 / (1 + exp(-total))


def table(n=900):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        bad, rude = k % 4 == 0, k % 5 == 0
        text = [rng.choice(["foo", "Bar", "baz", "qüx", f"w{rng.randrange(500)}"]) + ("###" if bad else "") for _ in range(60)]
        if rude:
            text[rng.randrange(60)] = "scoundrel"
        rows.append((k, " ".join(text), "good" if not bad or rng.random() < 0.2 else "mill", "en", None if k % 7 else 300, "x"))
        if k % 3:
            labels.append((k, int(not bad), int(rude)))
    return rows, labels


def test_scores_against_a_plain_version(spark):
    rows, labels = table()
    rows += [(9001, None, None, None, None, None), (9002, "", "mill", "en", 0, None), rows[5], (None, "foo bar", "good", None, 7, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame([*labels, (1, labels[0][1], labels[0][2]), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = op.classified(docs, known).collect()
    assert len(out) == len(rows)
    models = op.fit(docs.fillna("", ["text"]), known)
    want = {t: {r[0]: plain(models, t, r[1] or "", r[2], r[3], r[4]) for r in rows} for t in op.TARGETS}
    for r in out:
        assert r.quality_score == pytest.approx(want["quality"][r.doc_id]) and r.toxic_score == pytest.approx(want["toxic"][r.doc_id])
        assert r.kept == (r.quality_score >= 0.5 and r.toxic_score < 0.5)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 0]
    assert np.mean([(r.quality_score >= 0.5) == (r.doc_id % 4 != 0) for r in held]) > 0.95
    assert np.mean([(r.toxic_score >= 0.5) == (r.doc_id % 5 == 0) for r in held]) > 0.95


def test_views_teach_each_other_from_all_rows_without_a_label(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(op.CoTrained, "teach", lambda self, view, at, labels, real=op.CoTrained.teach: (taught.append((view, len(at), set(labels))), real(self, view, at, labels))[1])
    monkeypatch.setattr(op, "GIVEN", 30)
    rows, labels = table()
    op.fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    # the text view is sure of rows of which the metadata says little
    assert 1 in {v for v, _, _ in taught} and all(0 < n <= 30 and len(t) == 1 for _, n, t in taught)


def test_the_surest_are_those_of_a_plain_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), float(rng.randrange(20)), k, k % 7) for k in range(500)]
    got = op._surest(spark.createDataFrame(rows, op.SURE_OF), 12).collect()
    for code in range(3):
        want = sorted((-z, d, h) for c, z, d, h in rows if c == code)[:12]
        assert sorted((-r.z, r.doc_id, r.h) for r in got if r.code == code) == want


def test_long_texts_have_the_features_of_their_whole(monkeypatch):
    rng = random.Random(5)
    texts = ["a b", " ".join(f"W{rng.randrange(5000)}é!" for _ in range(300_000)), "c"]
    column = pa.array(texts)
    got = list(op._views(column, [[None] * 3] * 3))
    assert [x[:2] for x in got] == [(0, 1), (1, 2), (2, 3)]
    data, at = common.buffers(column)
    flat, counts, shape = op.text_features(data, at)
    assert np.concatenate([v[0][0] for _, _, v in got]).tolist() == flat.tolist()
    assert np.concatenate([v[0][1] for _, _, v in got]).tolist() == counts.tolist()
    assert np.concatenate([v[0][2] for _, _, v in got]) == pytest.approx(shape)


def test_nothing_to_learn(spark):
    rows, _ = table(20)
    docs = spark.createDataFrame(rows, SCHEMA)
    for labels in ([], [(1, 1, 0)], [(1, 1, 0), (2, 1, 0), (777, 0, 1)]):
        out = op.classified(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(out) == 20 and len({r.quality_score for r in out}) == 1
    assert op.classified(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


def plain_cotraining(rows, labels, target, order):
    """The rounds by plain means, for one target: (words that the text view knows, what each view was taught). order: what rows are sorted by."""
    where = op.TARGETS.index(target)
    label = {d: x[where] for d, *x in labels}
    docs = sorted((r for r in rows if r[0] is not None), key=lambda r: order[r[0]])
    seen, shapes, metas = {}, {}, {}
    for d, text, source, lang, size, _ in docs:
        data, at = common.buffers(pa.array([text or ""]))
        flat, _, shape = op.text_features(data, at)
        seen[d], shapes[d], metas[d] = set(flat.tolist()), shape[0], op.meta_buckets(source, lang, size)
    given = [d for d, *_ in docs if d in label]
    apart = given[:: op.APART]
    taught = [[(d, label[d]) for d in given if d not in set(apart)] for _ in (0, 1)]
    prior = (sum(label[d] for d in given) + 1) / (len(given) + 2)
    base, limit = log(prior / (1 - prior)), log(op.SURE / (1 - op.SURE))
    used = set()

    def fitted():
        t = taught[0]
        n1, n0 = sum(y for _, y in t), sum(1 - y for _, y in t)
        known = []
        for w in sorted(set().union(*(seen[d] for d, _ in t))):
            a, b = sum(w in seen[d] for d, y in t if y), sum(w in seen[d] for d, y in t if not y)
            off = a * n0 / (n0 + n1) - b * n1 / (n0 + n1)
            if abs(off) * ((n0 + n1) ** 3 / max(1, (a + b) * (n0 + n1 - a - b) * n0 * n1)) ** 0.5 >= op.STRIKING:
                known.append(w)
        number = {w: i for i, w in enumerate(known)}

        def features(view, d):
            if view:
                return metas[d], []
            bins = [len(known) + k * op.BINS + min(op.BINS - 1, int(x * op.BINS)) for k, x in enumerate(shapes[d])]
            return [number[w] for w in sorted(seen[d]) if w in number] + bins, shapes[d]

        def many(view, ds):
            of = [features(view, d) for d in ds]
            return np.concatenate([x for x, _ in of]).astype(np.int64), np.array([len(x) for x, _ in of]), np.array([s for _, s in of]).reshape(len(ds), -1)

        scores = []
        for view in (0, 1):
            ds, ys = zip(*taught[view])
            model = op.Linear(len(known) + op.SHAPE * op.BINS, op.SHAPE) if view == 0 else op.Linear(op.META, 0)
            model.fit(*many(view, ds), np.array(ys, float), np.ones(len(ds)))
            a, b = op.calibration(model.logits(*many(view, apart)), np.array([label[d] for d in apart], float))
            scores.append(lambda d, view=view, model=model, a=a, b=b: a * float(model.logits(*many(view, [d]))[0]) + b)
        return known, scores

    known, scores = fitted()
    for _ in range(op.ROUNDS):
        surest = []
        for view in (0, 1):
            z = {d: scores[view](d) for d, *_ in docs if d not in label and d not in used}
            for y in (0, 1):
                fit = [(-abs(x), d) for d, x in z.items() if (x > 0) == bool(y) and abs(x) > limit and x * (x - base) > 0 and abs(x - base) > 1]
                surest.append((view, y, [d for _, d in sorted(fit)[: op.GIVEN]]))
        if not any(ds for *_, ds in surest):
            break
        for view, y, ds in surest:
            taught[1 - view] += [(d, y) for d in ds]
            used |= set(ds)
        known, scores = fitted()
    return known, taught


def test_rounds_against_plain_cotraining(spark, monkeypatch):
    monkeypatch.setattr(op, "GIVEN", 12)
    rows, labels = table(400)
    # with one target alone nothing that the other is sure of is used up
    monkeypatch.setattr(op, "TARGETS", ("quality",))
    models = op.fit(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([x[:2] for x in labels], "doc_id long, quality int"))
    order = {r.doc_id: r.h for r in spark.createDataFrame(rows, SCHEMA).select("doc_id", F.xxhash64("text").alias("h")).collect()}
    known, taught = plain_cotraining(rows, labels, "quality", order)
    m = models["quality"]
    assert np.flatnonzero(m.known.table >= 0).tolist() == known
    assert [len(at) for at, _ in m.taught] == [len(t) for t in taught]
    assert [sorted(y.tolist()) for _, y in m.taught] == [sorted(float(y) for _, y in t) for t in taught]
    assert len(taught[0]) + len(taught[1]) > 2 * len([1 for d, *_ in labels]) * 4 // 5 + 12


def test_rows_of_very_many_words_are_scored_but_teach_nothing(spark, monkeypatch):
    monkeypatch.setattr(op, "TAUGHT_BYTES", 40)
    rows, labels = table(60)
    out = op.classified(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == 60 and len({r.quality_score for r in out}) == 1
