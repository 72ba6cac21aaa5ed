"""Patterns of a linear-time dialect, checked and rewritten for Spark's regular expressions.

Accepted: what has no lookaround, backreference, atomic or possessive part.
Classes and case folding follow Unicode. Line mode matches one line at a time;
multiline mode matches whole texts, where `.` also takes line ends.
"""

from __future__ import annotations

import re

from corpusloom.errors import ConfigError

# fixed values: POSIX classes and their Java names
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}


def translated(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """The pattern for Spark's rlike and regexp functions; ConfigError says what isn't accepted."""
    if multiline:
        pattern = with_line_ends(pattern)
    out: list[str] = []
    i, n, in_class = 0, len(pattern), 0
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise ConfigError("the pattern ends in a lone backslash")
            e = pattern[i + 1]
            if e.isdigit() and e != "0" or e == "k":
                raise ConfigError("backreferences are not supported")
            if e == "u" and pattern[i + 2 : i + 3] == "{":
                out.append("\\x")
            elif e == "z" and not in_class:
                out.append(r"\z")
            elif e in "Gg<>":
                raise ConfigError(f"the escape \\{e} is not supported")
            else:
                out.append("\\" + e)
            i += 2
            continue
        if in_class:
            if pattern.startswith("[:", i) and (m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])):
                if m[2] not in POSIX:
                    raise ConfigError(f"unknown class [:{m[2]}:]")
                name = POSIX[m[2]]
                out.append(name if not m[1] else f"[^{name}]")
                i += m.end()
                continue
            if pattern.startswith(("--", "~~"), i):
                raise ConfigError("differences of classes are not supported")
            in_class += (c == "[") - (c == "]")
            out.append(c)
            i += 1
            continue
        if c == "[":
            in_class = 1
            out.append(c)
            i += 1
            if pattern.startswith("^", i):
                out.append("^")
                i += 1
            if pattern.startswith("]", i):  # first in a class, it stands for itself
                out.append("\\]")
                i += 1
            continue
        if pattern.startswith("(?", i):
            rest = pattern[i + 2 :]
            if rest.startswith(("=", "!", "<=", "<!")):
                raise ConfigError("lookaround is not supported")
            if rest.startswith(">"):
                raise ConfigError("atomic groups are not supported")
            if rest.startswith("P<"):
                out.append("(?<")
                i += 4
                continue
            if rest.startswith(("P=", "P>", "R", "&", "(")):
                raise ConfigError("backreferences and conditions are not supported")
            out.append("(?")
            i += 2
            continue
        if c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise ConfigError("possessive repetition is not supported")
        if multiline and c == "$":
            out.append(r"(?=\r?\n|\z)")
        elif multiline and c == "^":
            out.append(r"(?<=\A|\n)")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise ConfigError("a class is not closed")
    return f"(?{'s' if multiline else 'd'}{'iu' if ignore_case else ''}U){''.join(out)}"


def with_line_ends(pattern: str) -> str:
    """Line breaks of a pattern, as they are or as \\n, also match CRLF."""
    return re.sub(r"(\\\\)|\\n|\n", lambda m: m[1] or r"\r?\n", pattern)


def checked(spark, pattern: str) -> str:
    """Compile a translated pattern once on the driver; a bad one is a ConfigError before any job."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise ConfigError(f"invalid pattern: {str(e).splitlines()[-1][:200]}") from None
    return pattern


def required_literal(pattern: str) -> str | None:
    """A string that every match of a case-sensitive pattern contains, where that is plain to see."""
    if re.search(r"[|()\[\]{}*?\\^$]", pattern):
        return None
    parts = [p for p in re.split(r"[.]|.\+", pattern) if p and "\n" not in p]
    return max(parts, key=len, default=None)
