"""Places of matches within lines, in characters, for the few lines that a page shows."""

from __future__ import annotations

import re as stdlib

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


def python_pattern(translated: str) -> regex.Pattern:
    """A translated pattern for the driver and for Python workers."""
    flags, body = stdlib.match(r"\(\?(\w*)\)(.*)", translated, stdlib.S).groups()
    keep = (regex.I if "i" in flags else 0) | (regex.S if "s" in flags else 0)
    return regex.compile(body.replace(r"\z", r"\Z"), keep | regex.V1)


def spans_of(pattern: regex.Pattern, line: str) -> list[tuple[int, int]]:
    """(start, length) of the matches in a line; an empty one right behind another match doesn't count."""
    out, end = [], -1
    for m in pattern.finditer(line):
        if m.end() > m.start() or m.start() != end:
            out.append((m.start(), m.end() - m.start()))
        end = m.end()
    return out


def nullable(translated: str) -> bool:
    """Whether a translated pattern may match without taking a character; these matches are found by spans_of()."""
    body = stdlib.sub(r"\\[pP](?:\{[^}]*\}|\w)", "x", stdlib.match(r"\(\?\w*\)(.*)", translated, stdlib.S)[1])
    body = stdlib.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", body.replace(r"\z", r"\Z"))
    body = stdlib.sub(r"\\x\{[^}]*\}|\\[QEhHvVRXN]", "x", body)
    try:
        return stdlib._parser.parse(body).getwidth()[0] == 0
    except Exception:
        return True


def count_spans(texts: Column, translated: str) -> Column:
    """How many matches an array of strings holds."""

    @F.pandas_udf("long")
    def step(rows: pd.Series) -> pd.Series:
        p = python_pattern(translated)
        return pd.Series([None if x is None else sum(len(spans_of(p, y)) for y in x) for x in rows])

    return step(texts)


def simple(translated: str) -> bool:
    """Whether Java finds the matches of a translated pattern as spans_of() does, however long a line is.

    Without choices and lazy parts what matches nothing could match no more there,
    where else Python looks again. A group that is repeated may hold no repetition
    and no group: Java matches these by recursion, as deep as a line is long.
    """
    body = stdlib.sub(r"\\(?:[pPx]\{[^}]*\}|.)", "x", stdlib.match(r"\(\?\w*\)(.*)", translated, stdlib.S)[1], flags=stdlib.S)
    if "\\Q" in translated or stdlib.search(r"\(\?[a-zA-Z-]*x", body):
        return False  # what is put around such a pattern may become part of it
    for part in (r"\[[^\[\]]*\]", r"\((?:\?:)?[^()\[\]|*+?{}]*\)"):
        while (less := stdlib.sub(part, "x", body)) != body:
            body = less
    return not stdlib.search(r"\[|\||\)[*+?{]|[*+?}]\?", body)


def count_in_lines(lines: Column, translated: str) -> Column:
    """How many matches an array of strings without line feeds holds, by spans_of() or in the JVM, which counts the same.

    Each match is put between line feeds, so that three of them in a row are an
    empty match right behind another, which doesn't count. Java also looks between
    the two halves of a character beyond U+FFFF; a match may not begin there.
    """
    if not simple(translated):
        return count_spans(lines, translated)
    flags, body = stdlib.match(r"(\(\?\w*\))(.*)", translated, stdlib.S).groups()
    marked = F.transform(lines, lambda x: F.regexp_replace(x, F.lit(rf"{flags}(?!\p{{Cs}})(?:{body})"), F.lit("\n$0\n")))
    of = lambda x, what: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(what), F.lit("")))
    return F.aggregate(marked, F.lit(0).cast("long"), lambda n, x: n + (of(x, "\n") / 2).cast("long") - (of(x, "\n\n\n") / 3).cast("long"))


def find_spans(line: Column, translated: str) -> Column:
    """An array of (char_start, char_len) of the matches in a line."""

    @F.pandas_udf("array<struct<char_start:int,char_len:int>>")
    def step(lines: pd.Series) -> pd.Series:
        p = python_pattern(translated)
        return pd.Series([[{"char_start": a, "char_len": n} for a, n in spans_of(p, x)] if x is not None else None for x in lines])

    return step(line)
