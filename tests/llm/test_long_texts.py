"""Texts of megabytes give what they give as a whole, in memory that slices bound."""

import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import common, op1_pieces, op2_jaccard


def text(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice(["Word", "été", "x", "1", "漢"]) * rng.randint(1, 3) + rng.choice([" ", "  ", "\n", ", ", "\t"]) for _ in range(n))


def test_parts_of_rows_are_the_rows():
    column = pa.array(["a b", None, text(400_000), "", "c" * (2 << 20), "d"])
    found = {}
    for a, b, data, at, first, last in common.parts_of_rows(column):
        assert (first and last) or b - a == 1
        assert len(data) <= common.SLICE_BYTES + 100 or b" " not in data.tobytes()
        for k in range(a, b):
            found[k] = found.get(k, b"") + data[at[k - a] : at[k - a + 1]].tobytes()
    assert [found[k].decode() for k in range(6)] == [x or "" for x in column.to_pylist()]


def test_shingles_of_a_long_text():
    long = text(400_000)
    column = pa.array(["one two", long, "three"])
    got = [s for _, _, sets in op2_jaccard.sets_of(column) for s in sets]
    data, at = common.buffers(column)
    want = op2_jaccard.shingle_sets(data, at)
    assert len(got) == 3 and all(np.array_equal(a, b) for a, b in zip(got, want))
    ids = [op2_jaccard.set_id(s) for s in got]
    assert len(set(ids)) == 3 and len({i for x in ids for i in x}) == 6 and op2_jaccard.set_id(want[0][:0]) == (0, 0)


def test_pieces_of_a_long_text(monkeypatch):
    import sentencepiece

    path = op1_pieces.model_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = op1_pieces.Pieces(path)
    texts = ["a b", "", "  two  ", text(3000), None, "x" * 900, "▁ ▁a", text(2, 5)]
    monkeypatch.setattr(op1_pieces, "SLICE", 500)
    got = [list(map(int, x)) for _, _, ids, counts in model.rows(pa.array(texts)) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [sp.encode(x or "") for x in texts]
    # with a memory of few parts and pairs
    monkeypatch.setattr(op1_pieces, "MEMORY", 50)
    monkeypatch.setattr(op1_pieces, "PAIRS", 10)
    assert model.encode(text(500, 9)).tolist() == sp.encode(text(500, 9))
