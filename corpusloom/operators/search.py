"""Searches over a corpus, as DataFrames: which files, how often, and where.

Every mode is one scan: lines are arrays within a file's row and matched by
functions on these, so that nothing is shuffled before the final order or
top-k, and no line leaves its row unless it is shown.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.errors import ConfigError
from corpusloom.functions.globs import glob_filter, type_filter
from corpusloom.functions.lines import search_lines
from corpusloom.functions.regexes import checked, required_literal, translated
from corpusloom.functions.spans import count_in_lines, count_spans, find_spans, nullable
from corpusloom.sources.corpus import Corpus

MODES = ("files_with_matches", "content", "count", "summary")
#: Bytes of matching lines of a file beyond which it is skipped.
CAPTURED = 64 << 20
#: A character that is put in front of matches.
_MARK = "\ue000"


@dataclass(frozen=True)
class Search:
    """What to search for; `context` stands for both sides, and contexts act in content mode only."""

    pattern: str
    glob: str | list[str] | None = None
    type: str | None = None
    output_mode: str = "files_with_matches"
    case_insensitive: bool = False
    only_matching: bool = False
    before_context: int = 0
    after_context: int = 0
    context: int | None = None
    multiline: bool = False

    def __post_init__(self):
        if self.output_mode not in MODES:
            raise ConfigError(f"unknown output mode {self.output_mode!r}")
        if min(self.before_context, self.after_context, self.context or 0) < 0:
            raise ConfigError("a context is negative")

    @property
    def around(self) -> tuple[int, int]:
        if self.output_mode != "content":
            return 0, 0
        return (self.before_context, self.after_context) if self.context is None else (self.context, self.context)

    def regex(self, spark) -> str:
        return checked(spark, translated(self.pattern, self.case_insensitive, self.multiline))


def selected(corpus: Corpus, s: Search) -> DataFrame:
    """Files that path filters keep; a literal that each match needs is looked for in the whole text first."""
    files = corpus.files
    if (keep := glob_filter(F.col("rel"), s.glob)) is not None:
        files = files.where(keep)
    if s.type:
        files = files.where(type_filter(F.col("rel"), s.type))
    if not s.case_insensitive and (literal := required_literal(s.pattern)):
        files = files.where(F.contains("text", F.lit(literal)))
    return files


def _hit(files: DataFrame, s: Search) -> Column:
    p = s.regex(files.sparkSession)
    if s.multiline:
        return F.rlike("text", F.lit(p))
    return F.exists(search_lines(F.col("text")), lambda x: F.rlike(x, F.lit(p)))


def _occurrences(files: DataFrame, s: Search) -> Column:
    regex = s.regex(files.sparkSession)
    p = F.lit(regex)
    if nullable(regex):  # Java counts empty matches behind others, too
        return count_spans(F.array("text"), regex) if s.multiline else count_in_lines(search_lines(F.col("text")), regex)
    if s.multiline:
        return F.regexp_count("text", p).cast("long")
    return F.aggregate(search_lines(F.col("text")), F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x, p))


def files_with_matches(corpus: Corpus, s: Search) -> DataFrame:
    """rel, mtime_ns of each file with a match; a file's lines are looked at up to the first hit."""
    files = selected(corpus, s)
    return files.where(_hit(files, s)).select("rel", "mtime_ns")


def counts(corpus: Corpus, s: Search) -> DataFrame:
    """rel, mtime_ns, occurrences of each file with a match."""
    files = selected(corpus, s)
    return files.select("rel", "mtime_ns", _occurrences(files, s).alias("occurrences")).where("occurrences > 0")


def summary(corpus: Corpus, s: Search) -> DataFrame:
    """files, occurrences: one row."""
    return counts(corpus, s).agg(F.count("*").alias("files"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once a row. A column that is named instead is put wherever its name stands, into filters and lambdas too, and computed in each place."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _shown(s: Search, p: Column, lines: Column) -> Column:
    """Numbers of the lines with a match and of those around them, in order."""
    before, after = s.around
    hits = F.filter(F.transform(lines, lambda x, i: F.when(F.rlike(x, p), i + 1)), lambda i: i.isNotNull())
    if not (before or after):
        return hits
    near = lambda h: F.sequence(F.greatest(h - before, F.lit(1)), F.least(h + after, F.size(lines)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, near))))


def _line_bytes(lines: Column, shown: Column) -> Column:
    return F.aggregate(shown, F.lit(0).cast("long"), lambda n, i: n + F.octet_length(F.element_at(lines, i)))


def _in_blocks(lines: Column, shown: Column) -> Column:
    """(line_no, line, block) of each line that is shown, of which there is one at least."""
    # places in `shown` at which a block begins, and the lines of each block
    begins = F.filter(F.sequence(F.lit(0), F.size(shown) - 1), lambda i: (i == 0) | (F.get(shown, i) > F.get(shown, i - 1) + 1))
    one = lambda i, j: F.struct(i.cast("long").alias("line_no"), F.element_at(lines, i).alias("line"), (j + 1).cast("long").alias("block"))
    block = lambda bs, b, j: F.transform(F.slice(shown, b + 1, F.coalesce(F.get(bs, j + 1), F.size(shown)) - b), lambda i: one(i, j))
    return _let(begins, lambda bs: F.flatten(F.transform(bs, lambda b, j: block(bs, b, j))))


def matching_lines(corpus: Corpus, s: Search) -> DataFrame:
    """rel, mtime_ns, line_no, line, is_match, block of matching lines and those around them.

    Blocks of a file that touch or overlap are one; they are counted from 1. A
    file whose shown lines have more than CAPTURED bytes is in capture_skips()
    instead.
    """
    files = selected(corpus, s)
    p = F.lit(s.regex(files.sparkSession))
    few = lambda lines, shown: F.when((F.size(shown) > 0) & (_line_bytes(lines, shown) <= CAPTURED), _in_blocks(lines, shown))
    entries = _let(search_lines(F.col("text")), lambda lines: _let(_shown(s, p, lines), lambda shown: few(lines, shown)))
    is_match = F.lit(True) if s.around == (0, 0) else F.rlike("x.line", p)
    return files.select("rel", "mtime_ns", F.explode(entries).alias("x")).select("rel", "mtime_ns", "x.line_no", "x.line", is_match.alias("is_match"), "x.block")


def _found(s: Search, p: Column) -> Column:
    """(line_no, ordinal, matched) of a file's matches with a pattern that isn't empty-able."""
    one = lambda line, k, m: F.struct(line.cast("long").alias("line_no"), (k + 1).cast("long").alias("ordinal"), m.alias("matched"))
    if s.multiline:
        # each match gets a mark in front, so that a line's marks, less those it has anyway, are the matches that begin in it
        marks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(_MARK), F.lit("")))
        counts = F.zip_with(F.split(F.regexp_replace("text", p, F.lit(_MARK + "$0")), "\n", -1), F.split("text", "\n", -1), lambda x, y: marks(x) - marks(y))
        starts = F.flatten(F.transform(counts, lambda n, i: F.array_repeat(i + 1, n)))
        pairs = F.zip_with(F.regexp_extract_all("text", p, F.lit(0)), starts, lambda m, n: F.struct(n.alias("n"), m.alias("m")))
        return F.transform(pairs, lambda x, k: one(x["n"], k, x["m"]))
    per_line = F.transform(search_lines(F.col("text")), lambda x: F.regexp_extract_all(x, p, F.lit(0)))
    return F.flatten(F.transform(per_line, lambda ms, i: F.transform(ms, lambda m, k: one(i + 1, k, m))))


def _match_bytes(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["matched"]))


def capture_skips(corpus: Corpus, s: Search) -> DataFrame | None:
    """path, reason, kind of files that a search of content leaves out for the bytes it would show; None where it can't leave out any."""
    whole = not (s.only_matching or s.multiline)
    regex = s.regex(corpus.files.sparkSession)
    if not whole and nullable(regex):
        return None
    p = F.lit(regex)
    if whole:
        captured = _let(search_lines(F.col("text")), lambda lines: _let(_shown(s, p, lines), lambda shown: _line_bytes(lines, shown)))
    else:
        captured = _match_bytes(_found(s, p))
    rows = selected(corpus, s if whole else replace(s, only_matching=True)).select("rel", captured.alias("captured")).where(F.col("captured") > CAPTURED)
    what = "matching lines" if whole else "matches"
    return rows.select(F.col("rel").alias("path"), F.concat(F.lit(f"its {what} have "), F.col("captured").cast("string"), F.lit(f" bytes, more than {CAPTURED}")).alias("reason"), F.lit("captured").alias("kind"))


def occurrences(corpus: Corpus, s: Search) -> DataFrame:
    """rel, mtime_ns, line_no, ordinal, matched of each match within a line, or (multiline) in a whole text, with line_no that of its start.

    A file whose matches have more than CAPTURED bytes is in capture_skips()
    instead, unless the pattern can match nothing.
    """
    regex = s.regex(corpus.files.sparkSession)
    if not nullable(regex):
        few = _let(_found(s, F.lit(regex)), lambda found: F.when(_match_bytes(found) <= CAPTURED, found))
        return selected(corpus, replace(s, only_matching=True)).select("rel", "mtime_ns", F.explode(few).alias("x")).select("rel", "mtime_ns", "x.*")
    files = selected(corpus, replace(s, only_matching=True))
    if s.multiline:
        rows = files.select("rel", "mtime_ns", "text", F.posexplode(find_spans(F.col("text"), regex)).alias("k", "x"))
        before = F.left("text", F.col("x.char_start"))
        line_no = 1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
        return rows.select("rel", "mtime_ns", line_no.cast("long").alias("line_no"), (F.col("k") + 1).cast("long").alias("ordinal"), F.substring("text", F.col("x.char_start") + 1, F.col("x.char_len")).alias("matched"))
    rows = files.select("rel", "mtime_ns", F.posexplode(search_lines(F.col("text"))).alias("k", "line")).where(F.rlike("line", F.lit(regex)))
    found = F.transform(find_spans(F.col("line"), regex), lambda x: F.substring("line", x["char_start"] + 1, x["char_len"]))
    rows = rows.select("rel", "mtime_ns", (F.col("k") + 1).cast("long").alias("line_no"), F.posexplode(found).alias("j", "matched"))
    return rows.select("rel", "mtime_ns", "line_no", (F.col("j") + 1).cast("long").alias("ordinal"), "matched")


def touched_lines(found: DataFrame) -> DataFrame:
    """rel, ordinal, line_no of each line that a match of occurrences() covers; a line break at its end touches no further line."""
    body = F.regexp_replace("matched", r"\r?\n\z", "")
    last = F.col("line_no") + F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    return found.select("rel", "ordinal", F.explode(F.sequence("line_no", last.cast("long"))).alias("line_no"))


def result(corpus: Corpus, s: Search) -> DataFrame:
    """The rows of a search in its output mode, unordered."""
    if s.output_mode == "content":
        return occurrences(corpus, s) if s.only_matching or s.multiline else matching_lines(corpus, s)
    return {"files_with_matches": files_with_matches, "count": counts, "summary": summary}[s.output_mode](corpus, s)


def enough(corpus: Corpus, s: Search, n: int) -> bool:
    """Whether a search has more than n entries; it stops looking once it has."""
    rows = result(corpus, s)
    return (rows.where("is_match") if "is_match" in rows.columns else rows).limit(n + 1).count() > n


def ordered(corpus: Corpus, s: Search) -> DataFrame:
    """The rows of a search, newest files first, ties by path, lines in order."""
    out = result(corpus, s)
    if s.output_mode == "summary":
        return out
    more = [c for c in ("line_no", "ordinal") if c in out.columns]
    return out.orderBy(F.desc("mtime_ns"), "rel", *more)


def page(corpus: Corpus, s: Search, limit: int, offset: int = 0) -> tuple[list, bool]:
    """At most `limit` rows from `offset` on, and whether more follow: one top-k job of limit + 1 rows."""
    rows = ordered(corpus, s).offset(offset).limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit
