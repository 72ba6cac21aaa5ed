"""License scans as an exact set-similarity join, in DataFrame operations alone.

Templates of notices and lines of text are sets of words. Words are ordered by
their frequency over all documents, rare ones first. A line can hold THRESHOLD
of a template's words only if it has one of the template's rarest words (prefix
filter), enough words of templates at all (length filter), and enough words
left behind the first common one (positional filter); what passes is compared
exactly. A notice that is wrapped over lines, or stands in a longer line, is
found by the same prefix words: around each, runs of as many words as the
template may have at that threshold are compared. Phrases are found beside that,
by place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, once A-Z are lower case.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Words of templates that are looked at together when runs are compared.
CHUNK = 256

# fixed values: phrases and their labels
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# fixed values: words of well-known notices and their labels
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2.0-header",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-header",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-text",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl-header",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license": "agpl-header",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2.0-header",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-text",
    "this is free and unencumbered software released into the public domain": "unlicense-text",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-1.0-text",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability": "mit-warranty",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties": "bsd-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-warranty",
}


def need(size: int, threshold: float = THRESHOLD) -> int:
    """Words of a template of that many that a line must hold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def reach(words: int, threshold: float = THRESHOLD) -> int:
    """Words of a run that is compared with a template of that many words: where they are the template's, others may be THRESHOLD's share less."""
    return max(words, math.floor(words / threshold + 1e-9))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, BREAK, -1), lambda w: w != "")


def literals(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by document frequency over all docs (text), rare first, then by name. Only one count per word comes to the driver."""
    # lower() also changes letters outside ASCII, which only shifts these frequencies
    found = F.array_intersect(literals(vocabulary), F.split(F.lower("text"), BREAK, -1))
    seen = {r.w: r["count"] for r in docs.select(F.explode(found).alias("w")).groupBy("w").count().collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def once(value: Column, f) -> Column:
    """f(value), with value computed once wherever f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def placed(text: Column, vocabulary: list[str]) -> Column:
    """(at, line, w) of each word of the vocabulary, at counted over all words of the text."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.transform(split_words(line), lambda w: F.struct(i.alias("line"), w.alias("w"))))
    every = F.transform(F.flatten(lines), lambda x, at: F.struct(at.alias("at"), x["line"].alias("line"), x["w"].alias("w")))
    return F.filter(every, lambda x: x["w"].isin(vocabulary))


def wrapped(spots: DataFrame, prefixes: DataFrame, heads: list[str], least: int, most: int) -> DataFrame:
    """row, label, line, last_line, lines, containment of the best run around each prefix word, if it meets the threshold.

    spots: row and what placed() gives. Rows are cut in chunks that overlap by
    the longest run, so none is longer than that, whatever the text.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.size("spots") - 1, F.lit(CHUNK)), lambda a: F.struct(F.least(a, F.lit(most)).alias("a"), F.slice("spots", F.greatest(a - most, F.lit(0)) + 1, F.least(a, F.lit(most)) + CHUNK + most).alias("p")))
    out = spots.select("row", F.explode(chunks).alias("chunk")).select("row", F.col("chunk.a").alias("a"), F.col("chunk.p").alias("p"))
    places = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda k: (k >= F.col("a")) & (k < F.col("a") + CHUNK) & F.get("p", k)["w"].isin(heads))

    def around(k: Column) -> Column:
        here = F.get("p", k)
        near = F.filter(F.slice("p", F.greatest(k - most, F.lit(0)) + 1, 2 * most + 1), lambda x: F.abs(x["at"] - here["at"]) < most)
        return F.struct(here["w"].alias("w"), here["at"].alias("at"), near.alias("near"))

    several = lambda x: F.size(F.array_distinct(F.transform(x["near"], lambda y: y["w"]))) >= least
    out = out.select("row", F.explode(F.filter(F.transform(places, around), several)).alias("x")).select("row", "x.*")
    # one row for each of the few words in prefixes of templates: its size doesn't depend on docs
    out = out.join(F.broadcast(prefixes), "w")

    def run(near: Column, s: Column) -> Column:
        """From one word on, up to where the last of the different words first stands."""
        within = F.filter(near, lambda y: (y["at"] >= s["at"]) & (y["at"] < s["at"] + F.col("reach")))
        new = once(within, lambda c: once(F.transform(c, lambda y: y["w"]), lambda names: F.filter(c, lambda y, i: F.array_position(names, y["w"]) == i + 1)))
        return once(new, lambda c: once(F.element_at(c, -1), lambda end: F.struct(F.size(c).alias("share"), (s["at"] - end["at"]).alias("short"), (-s["at"]).alias("early"), s["line"].alias("line"), end["line"].alias("last_line"))))

    def good(near: Column, best: Column) -> Column:
        lines = F.array_distinct(F.transform(F.filter(near, lambda x: x["line"].between(best["line"], best["last_line"])), lambda x: x["line"]))
        found = F.struct(best["line"].alias("line"), best["last_line"].alias("last_line"), lines.alias("lines"), (best["share"] / F.size("words")).alias("containment"))
        return F.when(best["share"] >= F.col("need"), found)

    def best(near: Column) -> Column:
        starts = F.filter(near, lambda x: x["at"] <= F.col("at"))
        enough = F.size(F.array_distinct(F.transform(near, lambda x: x["w"]))) >= F.col("need")
        return F.when(enough, once(F.array_max(F.transform(starts, lambda s: run(near, s))), lambda b: good(near, b)))

    mine = F.filter("near", lambda x: (F.abs(x["at"] - F.col("at")) < F.col("reach")) & F.array_contains("words", x["w"]))
    return out.select("row", "label", once(mine, best).alias("best")).where("best is not null").select("row", "label", "best.*")


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks for each row of docs (doc_id, text).

    blocks: (line, label, containment, last_line) of each line of at most reach()
    words that meets the threshold for a template, lines counted from 0, and of
    each run of reach() words, over several lines or within a longer one, that
    meets it with more than any such line that it touches (for each prefix word
    the best run, then the shortest, then the first); score: the best containment,
    0 without any. A null or empty text has no words, labels or blocks; repeated
    rows give repeated rows; an empty table gives none; other columns are ignored.
    A line of any length is searched by such runs, never as one set of words.
    """
    spark = docs.sparkSession
    templates_of = {label: t for t, label in templates.items()}
    sets = {label: sorted(set(t.split())) for label, t in templates_of.items()}
    order = word_order(docs, sorted({w for s in sets.values() for w in s}))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, s in sets.items():
        s.sort(key=rank.__getitem__)
        n = need(len(s), threshold)
        far = reach(len(templates_of[label].split()), threshold)
        rows += [(w, label, i, n, s, far) for i, w in enumerate(s[: len(s) - n + 1])]
    prefixes = spark.createDataFrame(rows, "w string, label string, i int, need int, words array<string>, reach int")
    least, heads_of, most = min(r[3] for r in rows), sorted({r[0] for r in rows}), max(r[5] for r in rows)

    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", F.col("text")).withColumn("_w", F.split(F.lower(text), BREAK, -1))
    out = out.withColumn("n_words", (F.size("_w") - F.when(F.element_at("_w", 1) == "", 1).otherwise(0) - F.when((F.size("_w") > 1) & (F.element_at("_w", -1) == ""), 1).otherwise(0)).cast("long"))
    heads = sorted({p.split()[0] for p in PHRASES})
    out = out.withColumn("_base", F.arrays_overlap("_w", literals(heads))).withColumn("_near", F.arrays_overlap("_w", literals(heads_of)))
    out = out.withColumn("_w", F.when(F.col("_base"), split_words(lowered(text))))

    def starts(phrase: str) -> Column:
        head, *rest = phrase.split()

        def here(i: Column) -> Column:
            c = F.get("_w", i) == head
            for k, w in enumerate(rest, 1):
                c &= F.coalesce(F.get("_w", i + k) == w, F.lit(False))
            return c

        return F.filter(F.sequence(F.lit(0), F.size("_w") - 1), here)

    none = F.array().cast("array<int>")
    for k, p in enumerate(PHRASES):
        out = out.withColumn(f"_p{k}", F.when(F.col("_base") & (F.size("_w") > 0), starts(p)).otherwise(none))
    sizes = [F.size(f"_p{k}") for k in range(len(PHRASES))]
    places = F.concat(*(F.col(f"_p{k}") for k in range(len(PHRASES))))
    base = F.filter(F.array(*(F.when(s > 0, F.lit(v)) for s, v in zip(sizes, PHRASES.values()))), lambda x: x.isNotNull())
    in_line = lambda line, i: once(split_words(line), lambda w: F.struct(i.alias("line"), F.size(w).alias("n"), F.array_intersect(literals(order), w).alias("r")))
    known = F.transform(F.split(lowered(text), "\n", -1), in_line)
    out = out.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", sum(sizes).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), F.array_distinct(base).alias("base"),
        F.when(F.col("_near"), F.filter(known, lambda x: (F.size(x["r"]) >= least) & (x["n"] <= most))).alias("near"),
        F.when(F.col("_near"), placed(lowered(text), order)).alias("spots"),
    )
    out = stored(out)

    tokens = out.where(F.size("near") > 0).select("row", F.explode("near").alias("b")).select("row", "b.line", "b.n", "b.r", F.posexplode("b.r").alias("j", "w"))
    # one row for each of the few words in prefixes of templates: its size doesn't depend on docs
    pairs = tokens.join(F.broadcast(prefixes), "w").where((F.size("r") >= F.col("need")) & (F.col("n") <= F.col("reach")))
    pairs = pairs.where(1 + F.least(F.size("words") - F.col("i") - 1, F.size("r") - F.col("j") - 1) >= F.col("need"))
    share = F.size(F.array_intersect("words", "r"))
    blocks = pairs.withColumn("share", share).where("share >= need").groupBy("row", "line", "label").agg(F.first(F.col("share") / F.size("words")).alias("containment"))
    runs = wrapped(out.where(F.size("spots") >= least).select("row", "spots"), prefixes, heads_of, least, most)
    # of a run and the lines that it touches, the run counts where it holds more
    runs = runs.withColumn("t", F.explode("lines")).join(blocks.select("row", "label", F.col("line").alias("t"), F.col("containment").alias("c")), ["row", "label", "t"], "left")
    runs = runs.groupBy("row", "line", "label", "last_line").agg(F.max("containment").alias("containment"), F.max("c").alias("c")).where("c is null or c < containment").drop("c")
    blocks = blocks.withColumn("last_line", F.col("line")).unionByName(runs)
    # bounded by lines and runs that hold a template
    found = blocks.groupBy("row").agg(F.max("containment").alias("best"), F.collect_set("label").alias("more"), F.sort_array(F.collect_list(F.struct("line", "label", "containment", "last_line"))).alias("blocks"))
    out = out.join(found, "row", "left")
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined("base").alias("base_labels"),
        joined(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"), "blocks",
    )


def oracle_sql() -> str:
    """SQL that compares each run of reach() words that begins with a word of a template, in texts that hold enough of them; a line of so many words is within such a run."""
    quoted = lambda s: "'" + s + "'"
    phrases = ", ".join(f"({quoted(p)}, {quoted(v)})" for p, v in PHRASES.items())
    templates = ", ".join(f"({quoted(' '.join(sorted(set(t.split()))))}, {quoted(v)}, {reach(len(t.split()))})" for t, v in TEMPLATES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return rf"""
with d as (select row_number() over () r, doc_id, {low} t from documents),
w as materialized (select r, doc_id, t, regexp_extract_all(t, '{word}') w from d),
p as (select string_split(s, ' ') p, v from (values {phrases}) z(s, v)),
h as (
  select r, i - 1 i, v from (select r, w, unnest(range(1, len(w) + 1)) i from w where contains(t, 'license') or contains(t, 'cc')), p
  where w[i] = p[1] and list_slice(w, i, i + len(p) - 1) = p),
b as (select r, count(*) n, min(i) f, max(i) l, list(distinct v) v from h group by r),
e as (select string_split(s, ' ') s, v, far from (values {templates}) z(s, v, far)),
c as materialized (select r, w, s, v, far from (select r, w, list_distinct(w) u from w), e where len(list_intersect(u, s)) / len(s) >= {THRESHOLD} - 1e-9),
x as (select r, v, s, list_slice(w, i, i + far - 1) l from (select *, unnest(range(1, len(w) + 1)) i from c) where list_contains(s, w[i])),
m as (
  select r, max(k) k, list(distinct v) v from (select r, v, len(list_intersect(l, s)) / len(s) k from x)
  where k >= {THRESHOLD} - 1e-9 group by r)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_base, f::bigint first_word, l::bigint last_word,
  coalesce(array_to_string(list_sort(b.v), ','), '') base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.v, []), coalesce(m.v, [])))), ','), '') labels,
  coalesce(k, 0)::double score
from w left join b using (r) left join m using (r)
"""
