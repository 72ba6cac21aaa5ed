"""Texts as arrays of lines, as searching and as reading see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines of more bytes are shown in part by searches; of more characters, by reads.
SEARCH_BYTES, READ_CHARS = 500, 2000


def search_lines(text: Column) -> Column:
    """N line breaks make N + 1 lines; CR goes with the LF behind it only."""
    return F.split(text, "\r?\n", -1)


def read_lines(text: Column) -> Column:
    """A final line break makes no line, and a CR at any line's end goes."""
    parts = F.split(text, "\n", -1)
    whole = F.when(text == "", F.array().cast("array<string>")).when(F.endswith(text, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, lambda x: F.regexp_replace(x, r"\r\z", ""))


def truncated(line: Column, most: int = READ_CHARS) -> Column:
    """A long line's beginning, with its length."""
    n = F.char_length(line)
    return F.when(n > most, F.concat(F.left(line, F.lit(most)), F.lit(" … (line of "), n.cast("string"), F.lit(" characters cut)"))).otherwise(line)
