import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import op1_pieces, op2_jaccard, op3_quality, op4_repeats, op5_language, op8_cotraining, op9_packing, op10_licenses
from corpusloom.llm.components import components
from corpusloom.llm.suffixes import suffix_array

from . import brute


@pytest.fixture(scope="module")
def rows():
    return brute.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    up = {x: x for e in edges for x in e if x is not None}

    def find(i):
        return i if up[i] == i else find(up[i])

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for e in edges if None not in e and e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(500):
        x = [rng.randint(0, rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(0, 30))]
        assert suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_pieces_are_those_of_the_library(spark, docs, nothing):
    import sentencepiece

    path = op1_pieces.model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = op1_pieces.decoded(op1_pieces.encoded(docs, path), path).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.ids == sp.encode(r.text or "") and (r.decoded or "") == (r.text or "")
    assert op1_pieces.encoded(nothing, path).count() == 0
    model, rng = op1_pieces.loaded(path), random.Random(4)
    for _ in range(300):
        x = "".join(rng.choice(["the", "ing", " ", "  ", "\n", ",", "1", "é", "漢", "😀", "▁", "q"]) for _ in range(rng.randint(0, 200)))
        assert model.encode(x).tolist() == sp.encode(x)
    long = "qwertyuiopthe" * 5000
    assert model.encode(long).tolist() == sp.encode(long)


@pytest.mark.parametrize("chunk", [1_500_000, 300])
def test_near_duplicates(docs, rows, nothing, monkeypatch, chunk):
    monkeypatch.setattr(op2_jaccard, "CHUNK", chunk)
    want = brute.near_components(rows)
    got = op2_jaccard.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert any(c != i for i, (_, c) in want.items())
    assert op2_jaccard.jaccard_components(nothing).count() == 0
    if chunk > 300:
        kept = op2_jaccard.near_duplicates_removed(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_near_duplicates_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(None, text), (4, text), (None, None), (None, "other")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in op2_jaccard.jaccard_components(df).collect()) == ["4", "4", "None", "None"]


def test_linked_sets_against_all_pairs():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64)) for _ in range(6)]
    sets = []
    for _ in range(120):
        b = base[rng.integers(6)].copy()
        b[rng.integers(len(b), size=rng.integers(0, 14))] = rng.integers(0, 1 << 60, 1)
        sets.append(np.unique(b))
    found, labels = op2_jaccard.linked(sets)
    assert all(op2_jaccard.similar(sets[a], sets[b]) for a, b in found)
    for i in range(120):
        for j in range(i):
            if op2_jaccard.similar(sets[i], sets[j]):
                assert labels[i] == labels[j]
    across = op2_jaccard.linked_across(sets[:60], sets[60:])
    assert all(op2_jaccard.similar(sets[a], sets[60 + b]) for a, b in across) and across


def test_quality(docs, rows, nothing):
    got = Counter(tuple(r) for r in op3_quality.quality(docs).select("doc_id", *op3_quality.COUNTS, "base_failed", "kept").collect())
    want = []
    for r in rows:
        c = brute.quality_counts(r[1])
        want.append((r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert Counter(k[:-1] for k in got.elements()) == Counter(want)
    assert all(not k[-1] for k in got if k[-2])
    kept = op3_quality.quality_kept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k[0] for k in got if k[-1]}
    assert op3_quality.quality(nothing).count() == 0 and op3_quality.quality_kept(nothing).count() == 0


def test_hosts_that_fail_are_rejected(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, good, "fine") for k in range(50)] + [(100 + k, "bad", "poor") for k in range(99)] + [(300, good, "poor")]
    out = {r.doc_id: r.kept for r in op3_quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0] and not out[100] and not out[300]


@pytest.mark.parametrize("limits", [(4096, 8192, 64, 1 << 20), (2, 50, 2, 1 << 20), (100_000, 50, 1, 300)])
def test_repeats(docs, rows, nothing, monkeypatch, limits):
    for name, value in zip(("GROUP_LIMIT", "SORTED_AT_ONCE", "SPREAD", "PIECE"), limits):
        monkeypatch.setattr(op4_repeats, name, value)
    want = Counter((r[0], *x[:4]) for r, x in zip(rows, brute.without_repeats([r[1] for r in rows])))
    out = op4_repeats.without_repeats(docs, ["doc_id", "text"])
    got = Counter(tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
    assert got == want
    assert op4_repeats.without_repeats(nothing, ["doc_id", "text"]).count() == 0
    if limits[0] == 4096:
        kept = {r.doc_id: r for r in op4_repeats.stripped(docs).collect()}
        for r, x in zip(rows, brute.without_repeats([r[1] for r in rows])):
            assert (kept[r[0]].text or "") == x[4].decode("utf-8", "ignore")
        assert op4_repeats.stripped(docs).columns == docs.columns


def test_repeats_pass_columns_of_any_name_through(spark):
    names = ["doc_id", "text", "copied", "spans", "kept", "text_id", "_id", "h2", "lo", "n_spans", "mixed"]
    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(260))
    rows = [(k, t, *range(9)) for k, t in enumerate([f"one {passage}", f"two {passage}", "same" * 60, "same" * 60, None, None, ""])]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    out = op4_repeats.without_repeats(docs).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in out] == [x[:3] for x in brute.without_repeats([r[1] for r in rows])]
    assert all((r.copied, r.spans, r.text_id, r["_id"], r.h2, r.lo, r.mixed) == (0, 1, 3, 4, 5, 6, 8) for r in out)
    kept = op4_repeats.stripped(docs).orderBy("doc_id")
    assert kept.columns == names and [tuple(r)[2:] for r in kept.collect()] == [r[2:] for r in rows]


def test_repeats_in_texts_of_megabytes(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage = " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(330_000))
    long = long[: 1 << 20][:-100] + passage + long[1 << 20 :]  # over the end of a piece
    rows = [(0, long), (1, "before " + passage + " behind"), (2, long[5:3000] + "?")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in op4_repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (len(long), len(passage) + 2995, 2), 1: (len(passage) + 14, len(passage), 1), 2: (2996, 2995, 1)}


def test_texts_that_share_a_hash_are_told_apart(spark, docs, rows, monkeypatch):
    # a first hash of a few values only
    monkeypatch.setattr(op4_repeats.F, "xxhash64", lambda *c, real=F.xxhash64: F.pmod(real(*c), F.lit(40)) if len(c) == 1 else real(*c))
    want = Counter((r[0], *x[:3]) for r, x in zip(rows, brute.without_repeats([r[1] for r in rows])))
    out = op4_repeats.without_repeats(docs, ["doc_id", "text"]).select("doc_id", "n_bytes", "n_removed", "n_spans")
    assert Counter(tuple(r) for r in out.collect()) == want


def test_languages(spark, nothing, docs):
    rng = random.Random(6)
    parts = {"aa": ["ka", "ki", "ko", "ta", "ti"], "bb": ["sch", "ung", "ein", "ver", "ich"], "cc": ["que", "eau", "oir", "ment", "les"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 40)))
    rows = [(k, make(lang), lang) for k in range(600) for lang in [sorted(parts)[k % 3]]] + [(9001, None, "aa"), (9002, "12 -- ²", "bb"), (9003, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = op5_language.languages(df).collect()
    assert {r.held_out for r in out if r.doc_id < 600} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert np.mean([r.lang == r.lang_pred for r in out if r.doc_id < 600 and r.held_out]) > 0.98
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id > 9000) and all(0 <= r.score <= 1 for r in out)
    assert op5_language.languages(nothing).count() == 0
    kept = op5_language.language_kept(docs)
    assert kept.columns == docs.columns and not any(r.text is None or not any(c.isalpha() for c in r.text) for r in kept.collect())
    # a model learns from nothing that isn't labelled
    assert {r.lang_pred for r in op5_language.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_rows_stay_where_no_language_is_learned(spark):
    texts = ["some words", "語", "12 -- ²", "", None]
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 3 == 1)
    for langs in ([None] * 6, ["aa", *[None] * 5], ["und"] * 6):
        rows = [(held, "held out words", langs[0]), *((200 + k, t, lang) for k, (t, lang) in enumerate(zip(texts, langs[1:])))]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert {r.doc_id for r in op5_language.language_kept(docs).collect()} == {held, 200, 201}


def test_cotraining(spark, nothing):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(900):
        bad, rude = k % 4 == 0, k % 5 == 0
        text = [rng.choice(["foo", "bar", "baz", "qux", f"w{rng.randrange(500)}"]) + ("###" if bad else "") for _ in range(60)]
        if rude:
            text[rng.randrange(60)] = "scoundrel"
        rows.append((k, " ".join(text), "good" if not bad or rng.random() < 0.2 else "mill", "en", None if k % 7 else 300))
        if k % 2:
            labels.append((k, int(not bad), int(rude)))
        elif k % 3 == 0:
            labels.append((k, int(not bad), int(rude)))
    rows += [(9001, None, None, None, None), (5, *rows[5][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = op8_cotraining.classified(docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"))
    got = [r for r in out.collect() if r.doc_id < 900]
    assert np.mean([(r.quality_score >= 0.5) == (r.doc_id % 4 != 0) for r in got]) > 0.97
    assert np.mean([(r.toxic_score >= 0.5) == (r.doc_id % 5 == 0) for r in got]) > 0.95
    assert out.count() == len(rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op8_cotraining.classified(docs, none).where("quality_score is null").count() == 0
    assert op8_cotraining.classified(nothing, none).count() == 0


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = op9_packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    want = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    got = op9_packing.packed(docs, path).collect()
    assert sum(r.length for r in got) == sum(len(x) for _, x in want)
    ids = dict(want)
    for r in got:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], np.uint32).tobytes())
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
    for x in by_sequence.values():
        x.sort(key=lambda r: r.offset)
        assert [r.offset for r in x] == [sum(y.length for y in x[:k]) for k in range(len(x))] and sum(r.length for r in x) <= 4096
    assert op9_packing.packed(nothing, path).count() == 0


def test_words_of_any_kind_are_encoded_as_by_the_tokenizer():
    from tokenizers import Tokenizer

    path = op9_packing.tokenizer_path()
    t, mine, rng = Tokenizer.from_file(path), op9_packing.WordBpe(path), random.Random(1)
    parts = ["the", "ING", " ", "  ", "\n", "\x1c", "\xa0", ",", "1", "é", "漢", "😀", "'s", "'LL", "É", "H̱", "\u0301", "<|endoftext|>", "<|", "½", "ǅ", "İ", "\u2028", "Σ", "ς", ".", "!?"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    ids, counts = mine.encode(pa.array(texts))
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    plain = [x for x in texts if "<|" not in x]
    ids, counts = mine.encode(pa.array(plain))
    assert ids.tolist() == [i for x, y in zip(texts, want) if "<|" not in x for i in y]


def least_cost(places, pen, length, free_from=None):
    best = [0.0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        costs = []
        for i in range(j):
            n = places[j] - places[i]
            if n <= length:
                free = free_from is not None and places[j] > free_from and n & (n - 1) == 0
                costs.append(best[i] + (0 if free else length - n) + pen[j])
        best[j] = min(costs)
    return best[-1]


def cost_of(places, pen, cuts, length, free_from=None):
    out = 0
    for a, b in zip([0, *cuts], cuts):
        n = places[b] - places[a]
        assert 0 < n <= length
        free = free_from is not None and places[b] > free_from and n & (n - 1) == 0
        out += (0 if free else length - n) + pen[b]
    return out


@pytest.mark.parametrize("free", [False, True])
def test_window_cuts_cost_least(free):
    rng = random.Random(9)
    for _ in range(100):
        places = np.cumsum([0] + [rng.randint(1, 7) for _ in range(rng.randint(1, 12))])
        pen = np.array([rng.choice([0.0, 1.0, 3.0]) for _ in places])
        free_from = int(places[-1]) - 10 if free else None
        cuts = op9_packing.window_cuts(places, pen, 10, free_from)
        assert cuts[-1] == len(places) - 1
        assert cost_of(places, pen, cuts, 10, free_from) == pytest.approx(least_cost(places, pen, 10, free_from))


def test_packing_of_whole_partitions_costs_least(monkeypatch):
    monkeypatch.setattr(op9_packing, "LENGTH", 64)
    rng = np.random.default_rng(4)
    closing = np.zeros(11, bool)
    closing[7] = True
    for turn in range(20):
        ids = rng.integers(3, 11, rng.integers(50, 900)).astype(np.uint32)
        if turn % 2:
            ids[ids == 7] = 3  # no sentence ends: documents that are longer than a window are cut inside
        ends = np.unique(np.append(rng.integers(1, len(ids), 5), len(ids)))
        packer = op9_packing._Packer(0, closing)
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            packer.add(k, ids[a:b])
        packer.pack(True)
        rows = packer.batch().to_pylist()
        places, pen = op9_packing.candidate_cuts(ids, ends, closing, 64, True)
        kinds = dict(zip(places.tolist(), pen.tolist()))
        inside = [p for p in places if p < len(ids) - 64 and p not in ends and p > 0 and ids[p - 1] != 7]
        assert all(any(a < p < b and b - a > 64 for a, b in zip([0, *sorted({*ends, *(np.flatnonzero(ids == 7) + 1)})], sorted({*ends, *(np.flatnonzero(ids == 7) + 1)}))) for p in inside)
        sizes = Counter()
        for r in rows:
            sizes[r["sequence_id"]] += r["length"]
        cuts = np.cumsum([sizes[k] for k in sorted(sizes)])
        index = {p: i for i, p in enumerate(places.tolist())}
        assert cost_of(places, pen, [index[c] for c in cuts.tolist()], 64, len(ids) - 64) == pytest.approx(least_cost(places, pen, 64, len(ids) - 64)) and kinds[len(ids)] == 0


def test_documents_longer_than_a_block(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = op9_packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["some", "words", "Here,", "end.", "\n"]) for _ in range(n)) for n in (600_000, 10, 30_000)] + ["x" * 9000]
    got = op9_packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path).collect()
    monkeypatch.setattr(op9_packing, "SLICE", 1000)  # texts are cut at white space while they are encoded
    again = [n for _, _, n in op9_packing.WordBpe(path).rows(pa.array(texts))]
    assert np.concatenate(again).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    for k, x in enumerate(texts):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        mine = sorted((r for r in got if r.doc_id == k), key=lambda r: r.start)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]] and sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], np.uint32).tobytes()) for r in mine)
        # a cut inside a document comes behind a sentence, but in the last window
        ends = [r.start + r.length for r in mine[:-1]]
        if k == 0:
            closing = {i for s in (".",) for i in t.encode(s).ids}
            assert all(ids[e - 1] in closing for e in ends)


def test_licenses(docs, rows, nothing):
    out = {r.doc_id: r for r in op10_licenses.licenses(docs).collect()}
    r = next(out[x[0]] for x in rows if x[1] and x[1].startswith("Released"))
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (13, 4, 3, 11)
    assert r.base_labels == "apache,cc-by,gpl,mit" and r.labels == "apache,cc-by,gpl,mit,mit-notice" and r.score == 1.0
    assert [(b.line, b.label) for b in r.blocks] == [(0, "mit-notice")]
    assert len(op10_licenses.licenses(docs).collect()) == len(rows)
    assert op10_licenses.licenses(nothing).count() == 0


def test_licenses_wrapped_over_lines(spark, monkeypatch):
    monkeypatch.setattr(op10_licenses, "CHUNK", 4)
    text_of = {v: t for t, v in op10_licenses.TEMPLATES.items()}

    def wrap(words, k, mark=""):
        return "\n".join(mark + " ".join(words[i : i + k]) for i in range(0, len(words), k))

    rng = random.Random(5)
    other = lambda n: " ".join(rng.choice(["the", "license", "of", "bada", "kodu", "\n"]) for _ in range(n))
    texts = [wrap(text_of[label].upper().split(), k, mark) for label in ("mit-text", "apache-2.0-header", "gpl-header") for k, mark in ((13, ""), (5, " * "), (1, "// "))]
    texts += [f"{other(300)}\n\n{t}\n{other(300)}" for t in texts]
    texts += [text_of["mit-text"], wrap((text_of["mit-text"].replace(" ", " b b b ")).split(), 9), "released under\n\n\nthe MIT", "", None]
    every = list(text_of.values())
    for _ in range(60):
        w = [rng.choice([*rng.choice(every).split(), "b"]) for _ in range(20)]
        t = rng.choice(every).split()
        del t[rng.randrange(len(t)) : len(t) : rng.choice([3, 5, 9])]
        texts.append(wrap(w + t + w[:5], rng.choice([2, 4, 9])))

    def plain(text):
        words = [(w, i) for i, line in enumerate(brute.low(text).split("\n")) for w in line.replace("*", " ").replace("/", " ").split()]
        best = {}
        for t, label in op10_licenses.TEMPLATES.items():
            s, far = set(t.split()), op10_licenses.reach(len(t.split()))
            sets = [{w for w, _ in words[a : a + far]} for a in range(len(words))]
            share = max((len(s & x) / len(s) for x in sets), default=0)
            if share >= op10_licenses.THRESHOLD - 1e-9:
                best[label] = share
        return best

    got = {r.doc_id: r for r in op10_licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        want = plain(t)
        assert set(got[k].labels.split(",")) - set(op10_licenses.PHRASES.values()) - {""} == set(want)
        assert got[k].score == pytest.approx(max(want.values(), default=0))
        assert all(b.containment <= want[b.label] + 1e-9 for b in got[k].blocks or [])
    assert [(b.line, b.last_line, b.label, b.containment) for b in got[0].blocks] == [(0, 1, "mit-text", 1.0)]
    assert [b.last_line for b in got[18].blocks] == [0]


def test_pipeline(docs, rows, spark, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the same by plain means
    left = {r[0]: r for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    counts = {i: brute.quality_counts(r[1]) for i, r in left.items()}
    left = {i: r for i, r in left.items() if not (counts[i][0] < 50 or 100 * counts[i][4] > 50 * counts[i][0])}
    left = {i: left[i] for i, (_, c) in brute.near_components(list(left.values())).items() if i == c}
    texts = [x[4].decode("utf-8", "ignore") for x in brute.without_repeats([r[1] for r in left.values()])]
    counts = op9_packing.loaded(op9_packing.tokenizer_path()).encode(pa.array(texts))[1]
    want = {i: n + 1 for i, n in zip(left, counts.tolist())}
    assert {r.doc_id: r.doc_tokens for r in out} == want
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
