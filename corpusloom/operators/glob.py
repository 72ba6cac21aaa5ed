"""File discovery by globs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.errors import ConfigError
from corpusloom.functions.globs import glob_filter
from corpusloom.sources.corpus import Corpus

#: Matching files beyond which a glob is an error, and limits of a page.
MOST_FILES, MOST_LIMIT = 100_000, 1_000


def found(corpus: Corpus, pattern: str | list[str]) -> DataFrame:
    """rel, mtime_ns, size of files that a glob, or a list of globs and vetoes, keeps; texts aren't read."""
    keep = glob_filter(F.col("rel"), pattern)
    files = corpus.files.select("rel", "mtime_ns", "size")
    return files if keep is None else files.where(keep)


def ordered(rows: DataFrame, sort: str = "modified") -> DataFrame:
    """By time, newest first and then by path, or by path."""
    if sort not in ("modified", "path"):
        raise ConfigError(f"unknown order {sort!r}")
    return rows.orderBy(F.desc("mtime_ns"), "rel") if sort == "modified" else rows.orderBy("rel")


def details(rows: DataFrame) -> DataFrame:
    """entry: compact JSON of path, bytes and time (RFC 3339 in UTC, nine digits), in this order."""
    at = F.date_format(F.timestamp_seconds(F.floor(F.col("mtime_ns") / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss")
    modified = F.concat(at, F.lit("."), F.lpad((F.pmod(F.col("mtime_ns"), F.lit(1_000_000_000))).cast("string"), 9, "0"), F.lit("Z"))
    return rows.select("rel", "mtime_ns", F.to_json(F.struct(F.col("rel").alias("path"), F.col("size").alias("bytes"), modified.alias("modified"))).alias("entry"))


def page(corpus: Corpus, pattern: str | list[str], sort: str = "modified", offset: int = 0, limit: int = 100) -> tuple[list, int]:
    """Rows of a page and the number of all matches; ConfigError above MOST_FILES matches."""
    if not 1 <= limit <= MOST_LIMIT:
        raise ConfigError(f"limit must lie in 1..{MOST_LIMIT}")
    rows = found(corpus, pattern)
    total = rows.limit(MOST_FILES + 1).count()
    if total > MOST_FILES:
        raise ConfigError(f"more than {MOST_FILES} files match; narrow the pattern")
    return ordered(rows, sort).offset(offset).limit(limit).collect(), total


#: Rows of a table of globs, at most; it is broadcast.
MOST_GLOBS = 10_000


def kept_by_table(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """files (rel) that some glob of patterns (regex, veto) keeps and none vetoes; without any that keeps, all are kept.

    For lists too long to write out: one semi and one anti join whose condition
    is the match. The regexes are those of as_regex().
    """
    n = patterns.limit(MOST_GLOBS + 1).count()
    if n > MOST_GLOBS:
        raise ConfigError(f"more than {MOST_GLOBS} globs")
    good, bad = patterns.where("not veto"), patterns.where("veto")
    hit = F.expr("rel rlike regex")
    if good.limit(1).count():
        files = files.join(F.broadcast(good), hit, "left_semi")
    return files.join(F.broadcast(bad), hit, "left_anti")
