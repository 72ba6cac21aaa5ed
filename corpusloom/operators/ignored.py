"""Ignore rules over tables of paths, as a join of paths with rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.globs import as_regex
from corpusloom.sources.ignore import NAMES, rule

#: Rules that are broadcast at most; more are dealt by key, those that any name may match in SALT parts.
BROADCAST_RULES, SALT = 20_000, 16
RULES = "folder string, rank int, line_no long, kind string, key string, regex string, keep boolean, folders boolean"
_PLAIN = re.compile(r"[^*?\[\]{}\\/]+")


def keyed(glob: str) -> tuple[str, str]:
    """How a glob is looked up: by a whole name, by a name's ending from a dot on, or ("any") by trying it."""
    name = glob.removeprefix("**/")
    if name != glob and _PLAIN.fullmatch(name):
        return "name", name
    if name != glob and name.startswith("*.") and _PLAIN.fullmatch(name[1:]):
        return "ending", name[1:]
    return "any", ""


def rules_of(lines: DataFrame) -> DataFrame:
    """RULES of lines (folder, rank, line_no, line) of ignore files: folder is '' at the top, rank orders the files of a folder. Comments, empty lines and globs that are wrong make none."""
    columns = [x.split()[0] for x in RULES.split(", ")]

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                found = rule(r.line or "")
                if found:
                    glob, keep, folders = found
                    out.append((r.folder or "", r.rank, r.line_no, *keyed(glob), as_regex(glob), keep, folders))
            yield pd.DataFrame(out, columns=columns)

    return lines.select("folder", F.col("rank").cast("int").alias("rank"), F.col("line_no").cast("long").alias("line_no"), "line").mapInPandas(f, RULES)


def lines_of(files: DataFrame) -> DataFrame:
    """folder, rank, line_no, line of the ignore files among files (rel, text)."""
    name = F.element_at(F.split("rel", "/"), -1)
    rank = F.array_position(F.array(*(F.lit(n) for n in NAMES)), name)
    own = files.where(name.isin(*NAMES)).select(F.regexp_replace("rel", "/?[^/]*$", "").alias("folder"), rank.cast("int").alias("rank"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return own.select("folder", "rank", (F.col("k") + 1).cast("long").alias("line_no"), "line")


def _entries(rel: Column) -> Column:
    """(entry, level, folders) of a path and the folders above it."""
    parts = F.split(rel, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("entry"), k.alias("level"), (k < F.size(parts)).alias("folders")))


def _looked_up(entry: Column) -> Column:
    """(folder, depth, kind, key) under which rules for an entry may stand: each folder above it, with its name, its name's endings, and what is tried."""
    parts = F.split(entry, "/")
    name = F.element_at(parts, -1)
    dots = F.filter(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substring(name, i, F.lit(1)) == ".")
    endings = F.transform(dots, lambda i: F.struct(F.lit("ending").alias("kind"), F.substring(name, i, F.length(name)).alias("key")))
    keys = F.concat(F.array(F.struct(F.lit("name").alias("kind"), name.alias("key")), F.struct(F.lit("any").alias("kind"), F.lit("").alias("key"))), endings)
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.struct(F.array_join(F.slice(parts, 1, d), "/").alias("folder"), d.alias("depth")))
    return F.flatten(F.transform(above, lambda a: F.transform(keys, lambda k: F.struct(a["folder"].alias("folder"), a["depth"].alias("depth"), k["kind"].alias("kind"), k["key"].alias("key")))))


def verdicts(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """rel, ignored of each row of paths (rel, files' paths from the top), by RULES.

    Of the rules that match an entry, that of the deepest folder, in it of the
    last file, in it of the last line, decides; a path is ignored if it or a
    folder above it is: what is in an ignored folder can't be kept. Names and
    endings are equality joins; only globs of other kinds are tried on all
    entries below their folder. A null path is not ignored; repeated paths stay;
    no rules ignore nothing.
    """
    every = paths.select("rel")
    rows = every.where("rel is not null").distinct().select("rel", F.explode(_entries(F.col("rel"))).alias("e")).select("rel", "e.*")
    rows = rows.select("*", F.explode(_looked_up(F.col("entry"))).alias("at")).select("rel", "level", "entry", F.col("folders").alias("is_folder"), "at.*")
    on = ["folder", "kind", "key"]
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        met = rows.join(F.broadcast(rules), on)
    else:
        salt = F.when(F.col("kind") == "any", F.pmod(F.xxhash64("rel"), F.lit(SALT))).otherwise(0).cast("int")
        copies = F.explode(F.when(F.col("kind") == "any", F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
        met = rows.withColumn("salt", salt).join(rules.select("*", copies), [*on, "salt"])
    inside = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.substring(F.col("entry"), F.length("folder") + 2, F.length("entry")))
    met = met.where((F.col("is_folder") | ~F.col("folders")) & ((F.col("kind") != "any") | F.rlike(inside, F.col("regex"))))
    decided = met.groupBy("rel", "level").agg(F.max_by("keep", F.struct("depth", "rank", "line_no")).alias("keep"))
    lost = decided.groupBy("rel").agg(F.bool_or(~F.col("keep")).alias("ignored"))
    return every.join(lost, "rel", "left").select("rel", F.coalesce("ignored", F.lit(False)).alias("ignored"))
