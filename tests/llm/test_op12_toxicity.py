import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import op12_toxicity as op

WORDS = "the cat sat on a mat and then it went home over some hills with its friend".split()


def plain_sentences(text):
    """(start, end, words) in characters, by plain means."""
    out, words, stops, last = [], [], 0, None
    places = [(m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    for a, b in places:
        stops = sum(c in ".!?\n\r" for c in text[:a])
        if not words or stops != last or len(words) == op.LONGEST:
            words = []
            out.append(words)
        words.append((a, b))
        last = stops
    return [(w[0][0], w[-1][1], [text[a:b] for a, b in w]) for w in out]


def plain_features(words):
    out = set()
    for w in words:
        b = re.sub(r"[A-Z]", lambda m: m.group().lower(), w).encode()
        out.add((0, b))
        out |= {(n, b[i : i + n]) for n in op.GRAMS for i in range(len(b) - n + 1)}
    return out


def bucket_of(kind, b):
    s = op.Sentences(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
    found = list(s.features())
    return int(found[0][1][0] if kind == 0 else found[1 + op.GRAMS.index(kind)][1][0])


def model_of(weights, b):
    buckets = [bucket_of(*f) for f in weights]
    assert len(set(buckets)) == len(buckets)
    m = op.Model(np.array(buckets))
    m.w, m.b = np.array(list(weights.values())), b
    return m


WEIGHTS = {(0, b"idiot"): 6.0, (4, b"scum"): 5.0, (5, "über".encode()): 4.5, (0, b"cat"): -1.0, (4, b"hill"): 0.5}


def plain_probabilities(text, b):
    return [1 / (1 + math.exp(-(b + sum(WEIGHTS.get(f, 0) for f in plain_features(w))))) for _, _, w in plain_sentences(text)]


def texts():
    rng = random.Random(1)
    parts = [*WORDS, "idiot", "IDIOT", "scums", "Überall", "é", "x1", "\x00", "-", ".", "!", "?\n", "\n", "\r\n", "…", "\U0001f600", "  "]
    made = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    return [*made, "", "...", "idiot", " ".join(["word"] * 200), "é" * 300, "a.b.c", "idiot idiot. idiot"]


def test_sentences_and_noisy_or_match_plain_means():
    rows, m = texts(), model_of(WEIGHTS, -4.0)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([False] * len(rows)), pa.array(rows)], ["doc_id", "held_out", "text"])
    got = [r for b in op._scored(m)(iter([batch])) for r in b.to_pylist()]
    assert len(got) == len(rows)
    for text, r in zip(rows, got):
        want = plain_sentences(text)
        p = plain_probabilities(text, -4.0)
        assert r["n_sentences"] == len(want)
        assert r["score"] == pytest.approx(1 - math.prod(1 - x for x in p))
        assert [(s["start"], s["end"]) for s in r["offending"]] == [(a, b) for (a, b, _), x in zip(want, p) if x >= op.OFFENDS]
        assert r["worst_score"] == pytest.approx(max(p, default=0))
        assert r["worst_start"] == (want[max(range(len(p)), key=lambda i: (round(p[i], 9), -i))][0] if p else None)


def test_a_long_text_in_parts(monkeypatch):
    from corpusloom.llm import common

    text = " . ".join(texts())
    m = model_of(WEIGHTS, -4.0)
    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([False, True]), pa.array([text, "an idiot"])], ["doc_id", "held_out", "text"])])
    whole = [r for b in op._scored(m)(batch()) for r in b.to_pylist()]
    cut = common.parts_of_rows
    monkeypatch.setattr(op, "parts_of_rows", lambda c: cut(c, 200))
    parts = [r for b in op._scored(m)(batch()) for r in b.to_pylist()]
    assert [r["doc_id"] for r in parts] == [1, 2] and parts[1] == whole[1]
    # a part's end may only cut a sentence in two
    assert parts[0]["n_sentences"] >= whole[0]["n_sentences"] and len(parts[0]["offending"]) >= len(whole[0]["offending"])
    for s in parts[0]["offending"]:
        assert re.search("idiot|scum|über", text[s["start"] : s["end"]], re.I)
    # the counts of a part's features are those of the whole text
    counted = lambda: [b.to_pydict() for b in op._counted(iter([pa.RecordBatch.from_arrays([pa.array([text]), pa.array([1], pa.int32())], ["text", "toxic"])]))]
    by_parts = counted()
    monkeypatch.setattr(op, "parts_of_rows", cut)
    assert by_parts == counted()


def test_gradient_is_that_of_the_loss(monkeypatch):
    rng = np.random.default_rng(0)
    bag, of, k = np.array([0, 0, 1, 2, 3]), np.array([0, 1, 1, 2, 3, 4]), np.array([0, 1, 2, 0, 2, 1])
    plain, y = np.array([1, 0, 3, 2, 4]), np.array([1, 1, 0, 0, 1])

    def loss(theta):
        z = np.bincount(of, theta[k], minlength=5) + theta[-1]
        none = np.bincount(bag, -np.logaddexp(0, z), minlength=5) - plain * np.logaddexp(0, theta[-1])
        return float(np.where(y > 0, -np.log(-np.expm1(none)), -none).mean() + (theta[:-1] ** 2).sum() / (2 * op.SPREAD**2 * 5))

    m = op.Model(np.array([10, 20, 30])).fit(bag, 5, of, k, plain, y)
    found = loss(np.append(m.w, m.b))
    # where fitting stops no small step is better
    assert all(loss(np.append(m.w, m.b) + rng.normal(size=4) * 0.05) >= found - 1e-4 for _ in range(200))


def planted(n):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choices(WORDS, k=8)) for _ in range(rng.randrange(1, 12))]
        toxic = rng.random() < 0.3
        if toxic:
            sentences.insert(rng.randrange(len(sentences) + 1), f"you {rng.choice(['grobnik', 'grobling', 'Grobbs'])} " + rng.choice(WORDS))
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_planted_sentences_are_found_in_rows_that_are_held_out(spark):
    rows, labels = planted(600)
    toxic = dict(labels)
    # labels of held-out rows are wrong here, and must not matter
    given = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    docs = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], "doc_id long, text string, toxic string, row int, score double")
    out = op.toxicity(docs, spark.createDataFrame(given, "doc_id long, toxic int")).collect()
    text = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7) == toxic[r.doc_id]
        found = [text[r.doc_id][s.start : s.end].lower() for s in r.offending]
        assert all("grob" in x for x in found) and bool(found) == bool(toxic[r.doc_id])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, ""), (4, "...")], "doc_id long, text string")
    for given in ([], [(1, 1)], [(None, 1), (1, None)], [(1, 0), (2, 1), (3, 1), (3, 0), (99, 1)], [(i, i % 2) for i in (1, 2, 3, 4)]):
        out = op.toxicity(docs, spark.createDataFrame(given, "doc_id long, toxic int")).collect()
        assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
        assert all(r.n_sentences == (1 if r.doc_id in (1, None) else 0) for r in out)
    assert op.toxicity(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0
    # one class alone: a smoothed share
    assert {r.score for r in op.toxicity(docs, spark.createDataFrame([(3, 1)], "doc_id long, toxic int")).collect()} in ({2 / 3}, {0.5})
