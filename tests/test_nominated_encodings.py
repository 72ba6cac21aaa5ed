"""nominated_encodings beside its SQL: texts whose legacy bytes could be taken for something else, in each of the five encodings."""

import random

import __spark_entry__

ODD = [
    "Lyly " * 21 + "that reaning " * 10,  # a beginning that was UTF-8 as well
    "bus " * 20,  # wholly UTF-8 as well
    "l", "x y", "s",
    "Ã© è " * 40, "Ã©" * 40, "ï»¿" + "é à " * 40, "é" * 8 + "Â¿" * 30,
    "ÿþ" + "é à " * 40, "þÿ" + "é à " * 40, "MZ é à " * 40, "Îúíþ é à " * 40, "MZ",
    "日本語" * 20, "“word” — " * 20, "\x93\x94\x85" * 20, "😀" * 40, "日本",
    "İK " * 20, "İ",
    None, "", "123", "\x00\x01\x1b$B\x7f", "\x1f\x8b abc",
]


def test_rows_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéèñüçäöêßíó", k=rng.randint(2, 8)))
    usual = [" ".join(word() for _ in range(60)) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(usual)] + [(1000 + 5 * i + k, t) for i, t in enumerate(ODD) for k in range(5)] + [(-k, usual[0]) for k in range(1, 6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["nominated_encodings"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: r for r in con.execute(__spark_entry__.oracle_sql()["nominated_encodings"]).fetchall()}
    assert len(got) == len(want) == len(rows)
    texts = dict(rows)
    assert not [(tuple(r), want[r.doc_id], texts[r.doc_id]) for r in got if tuple(r) != want[r.doc_id]]


def test_no_letter_is_written_in_utf8():
    from corpusloom.functions.decode import LEGACY
    from corpusloom.plans.queries import LETTERS, SCRIPTS

    for label, letters in SCRIPTS.items():
        assert len(set(letters)) == len(letters) == len(LETTERS)
        for x in letters:
            for follows in ("", *letters, " "):
                # the first byte must break UTF-8 by itself or with the next ones
                assert (x + follows).encode(LEGACY[label]).decode("utf-8", "replace").startswith("�")
