"""Every operator over tables of one or a few odd rows: a row comes back for each (packing: its pieces), whatever other columns there are."""

import pytest

from corpusloom.llm import op1_pieces, op2_jaccard, op3_quality, op4_repeats, op5_language, op6_katz, op7_embeddings, op8_cotraining, op9_packing, op10_licenses

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, w long, run long, part long, keys string, label string, ids string, words string"
MORE = (1, 2, 3, 4, "k", "l", "i", "w")
TABLES = {
    "two words": [(7, "two words", "en", "s", 9)],
    "all null": [(None, None, None, None, None)],
    "odd rows": [(1, "A b c d e f g", "en", "s", 13)] * 3
    + [(2, "other", None, "", 5), (3, " \n\t", "en", "s", 3), (4, "", "fr", None, 0), (5, "\x00\x1c ", "de", "t", 3), (6, None, None, None, None)]
    + [(8, "x" * 5000, "en", "s", 5000), (9, "x" * 5000 + "y", "en", "s", 5001)],
}


@pytest.mark.parametrize("name", TABLES)
def test_small_tables(spark, name):
    rows = [(*r, *MORE) for r in TABLES[name]]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    path = op1_pieces.model_path()
    assert [r.decoded or "" for r in op1_pieces.decoded(op1_pieces.encoded(docs, path), path).collect()] == [r[1] or "" for r in rows]
    for out in (op2_jaccard.jaccard_components(docs), op3_quality.quality(docs), op5_language.languages(docs), op6_katz.scored(docs), op8_cotraining.classified(docs, labels), op10_licenses.licenses(docs)):
        assert len(out.collect()) == len(rows)
    removed = op4_repeats.without_repeats(docs)
    assert removed.count() == len(rows) and {*SCHEMA.replace(",", "").split()[::2]} <= {*removed.columns}
    pieces = op9_packing.packed(docs, op9_packing.tokenizer_path()).collect()
    assert sum(r.start == 0 for r in pieces) == len(rows)
    for kept in (op2_jaccard.near_duplicates_removed(docs), op3_quality.quality_kept(docs), op4_repeats.stripped(docs), op5_language.language_kept(docs)):
        assert kept.columns == docs.columns and kept.count() <= len(rows)


def test_small_tables_of_vectors(spark):
    for rows in ([(1, [1.0], 1)], [(None, None, None)], [(1, [0.0], 1), (1, [0.0], 1)], [(1, [1.0, 2.0], 1)] * 3):
        out = op7_embeddings.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
        assert len(out) == len(rows) and {r.n_links for r in out} == {2 if len(rows) == 3 else 0}
