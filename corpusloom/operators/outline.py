"""Symbols of source files: definitions with their lines, nesting and first line."""

from __future__ import annotations

import ast
import keyword
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.errors import ConfigError
from corpusloom.functions.globs import extension

SIGNATURE_CHARS, INDENT = 200, "  "

# fixed values: extensions of languages
EXTENSIONS = {
    "rs": "rust", "go": "go", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "py": "python", "java": "java",
    "c": "cpp", "h": "cpp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp",
}


@dataclass
class Symbol:
    name: str
    label: str
    depth: int
    start_line: int
    end_line: int
    signature: str


def signature(line: str) -> str:
    """A definition's first line without what opens its body, cut to SIGNATURE_CHARS."""
    line = re.sub(r"[{;:\s]+$", "", line.strip())
    return line if len(line) <= SIGNATURE_CHARS else line[:SIGNATURE_CHARS] + "…"


# words of Python source, with what stands before them where that makes them part of an escape
_WORDS = re.compile(r"\\N\{[^}]*\}|\\?[\w\x80-\U0010ffff]+")
_NAMED = re.compile(r"\s*(?:async[\s\\]+)?(?:def|class)[\s\\]+(\w+)")
# fixed values: words that the parser knows
_KEPT = {*keyword.kwlist, *keyword.softkwlist, "__debug__", "__future__", "barry_as_FLUFL"}
_PREFIXES = {"rb", "br", "fr", "rf", "tr", "rt"}


def _masked(source: str) -> str:
    """Python source with each name as so many letters a. The parser keeps every name it has ever seen, so that a worker would grow with its files."""

    def mask(m: re.Match) -> str:
        word = m[0]
        if len(word) < 2 or not word.isascii() or not word.isidentifier() or word in _KEPT or word.lower() in _PREFIXES:
            return word
        return "a" * len(word)

    return _WORDS.sub(mask, source)


def python_symbols(source: str) -> list[Symbol]:
    """Functions and classes; a broken file is scanned by indentation instead."""
    lines = source.split("\n")
    try:
        tree = ast.parse(_masked(source))
    except (SyntaxError, ValueError, RecursionError):
        return _indented(lines)
    out = sorted(_defined(tree, 0, lines), key=lambda s: (s.start_line, -s.end_line))
    starts = [0, *(m.end() for m in re.finditer(r"\r\n?|\n", source))]
    for s in out:
        if not s.name.strip("a") and (m := _NAMED.match(source, starts[s.start_line - 1])):
            s.name = m[1]
    return out


def _defined(node: ast.AST, depth: int, lines: list[str]) -> Iterator[Symbol]:
    for child in ast.iter_child_nodes(node):
        inside = depth
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inside += 1
            label = "class" if isinstance(child, ast.ClassDef) else "def"
            yield Symbol(child.name, label, inside, child.lineno, child.end_lineno, signature(lines[child.lineno - 1]))
        yield from _defined(child, inside, lines)


def _indented(lines: list[str]) -> list[Symbol]:
    out: list[Symbol] = []
    open_: list[tuple[int, Symbol]] = []
    last = 0
    for k, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        width = len(line) - len(line.lstrip())
        while open_ and width <= open_[-1][0]:
            open_.pop()[1].end_line = last
        if m := re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)", line):
            s = Symbol(m[2], m[1], len(open_) + 1, k, k, signature(line))
            out.append(s)
            open_.append((width, s))
        last = k
    for _, s in open_:
        s.end_line = last
    return out


# what may stand before a definition, what it is called, and its name, by language
_RUST_HEAD = r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+|async\s+|unsafe\s+|const\s+(?=(?:async|unsafe|extern|fn)\b)|extern\s+(?:\"[^\"]*\"\s+)?)*"
_JAVA_HEAD = r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp|synchronized|native|default)\s+)*"
_JAVA_TYPE = r"(?!(?:public|protected|private|static|final|abstract|sealed|strictfp|synchronized|native|default)\b)[\w.]+(?:<.*?>)?(?:\[\])*\s+"
_TS_HEAD = r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_NOT_CALLS = r"(?!(?:if|for|while|switch|catch|return|new|else|do|throw|super|this|delete|case|sizeof|await|yield|assert)\b)"
RULES: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("fn", _RUST_HEAD + r"fn\s+(?P<name>\w+)"),
        ("struct", _RUST_HEAD + r"struct\s+(?P<name>\w+)"),
        ("enum", _RUST_HEAD + r"enum\s+(?P<name>\w+)"),
        ("union", _RUST_HEAD + r"union\s+(?P<name>\w+)\s*(?:<|\{|where)"),
        ("trait", _RUST_HEAD + r"(?:auto\s+)?trait\s+(?P<name>\w+)"),
        ("impl", _RUST_HEAD + r"impl\b(?:\s*<[^{]*?>)?\s+(?:[^{]*?\bfor\s+)?(?P<name>[\w:]+)"),
        ("mod", _RUST_HEAD + r"mod\s+(?P<name>\w+)"),
        ("type", _RUST_HEAD + r"type\s+(?P<name>\w+)"),
        ("const", _RUST_HEAD + r"const\s+(?P<name>\w+)\s*:"),
        ("static", _RUST_HEAD + r"static\s+(?:mut\s+)?(?P<name>\w+)\s*:"),
    ],
    "go": [
        ("method", r"^func\s*\([^)]*\)\s*(?P<name>\w+)"),
        ("func", r"^func\s+(?P<name>\w+)"),
        ("type", r"^\s*type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+[^(\s]"),
    ],
    "java": [
        ("@interface", _JAVA_HEAD + r"@interface\s+(?P<name>\w+)"),
        ("class", _JAVA_HEAD + r"class\s+(?P<name>\w+)"),
        ("interface", _JAVA_HEAD + r"interface\s+(?P<name>\w+)"),
        ("enum", _JAVA_HEAD + r"enum\s+(?P<name>\w+)"),
        ("record", _JAVA_HEAD + r"record\s+(?P<name>\w+)\s*[<(]"),
        ("method", _JAVA_HEAD + r"(?:<[^>]+>\s+)?" + _NOT_CALLS + _JAVA_TYPE + r"(?P<name>\w+)\s*\([^;=]*(?:\{|;|$|\bthrows\b)"),
        ("constructor", _JAVA_HEAD + _NOT_CALLS + r"(?P<name>[A-Z]\w*)\s*\([^;=]*(?:\{|,|\($)"),
        ("method", _JAVA_HEAD + r"(?:<[^>]+>\s+)?" + _NOT_CALLS + _JAVA_TYPE + r"(?P<name>\w+)\s*\([^);=]*$"),
    ],
    "typescript": [
        ("function", _TS_HEAD + r"(?:async\s+)?function\s*\*?\s*(?P<name>\w+)"),
        ("class", _TS_HEAD + r"(?:abstract\s+)?class\s+(?P<name>\w+)"),
        ("interface", _TS_HEAD + r"interface\s+(?P<name>\w+)"),
        ("type", _TS_HEAD + r"type\s+(?P<name>\w+)\s*(?:<.*>)?\s*="),
        ("enum", _TS_HEAD + r"(?:const\s+)?enum\s+(?P<name>\w+)"),
        ("namespace", _TS_HEAD + r"namespace\s+(?P<name>[\w.]+)"),
        ("module", _TS_HEAD + r"module\s+(?P<name>[\w.\"']+)\s*\{"),
        ("method", r"^\s+(?:(?:public|protected|private|static|override|readonly|async|get|set)\s+)*\*?" + _NOT_CALLS + r"(?P<name>[#\w]+)\s*(?:<[^>]*>)?\([^)]*$"),
        ("method", r"^\s+(?:(?:public|protected|private|static|override|readonly|async|get|set)\s+)*\*?" + _NOT_CALLS + r"(?P<name>[#\w]+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::\s*[^={;]+)?\{"),
    ],
    "cpp": [
        ("namespace", r"^\s*(?:inline\s+)?namespace\s+(?P<name>\w+)\s*\{?\s*$"),
        ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+|struct\s+)?(?P<name>\w+)[^;()]*(?:\{.*)?$"),
        ("struct", r"^\s*(?:typedef\s+)?(?:template\s*<.*>\s*)?struct\s+(?P<name>\w+)[^;()]*(?:\{.*)?$"),
        ("class", r"^\s*(?:template\s*<.*>\s*)?class\s+(?P<name>\w+)[^;()]*(?:\{.*)?$"),
        ("union", r"^\s*(?:typedef\s+)?union\s+(?P<name>\w+)[^;()]*(?:\{.*)?$"),
        ("using", r"^\s*(?:template\s*<.*>\s*)?using\s+(?P<name>\w+)\s*="),
        ("function", r"^\s*(?:template\s*<.*>\s*)?(?:(?:static|inline|constexpr|virtual|explicit|extern|friend)\s+)*" + _NOT_CALLS + r"(?:[\w:<>,&*\s]+?[\s&*]+)?(?P<name>~?[\w:~]+)\s*\([^=;]*\)[^;={]*(?:=\s*(?:default|delete|0)\s*)?(?:\{|;|$)"),
        ("function", r"^\s*(?:template\s*<.*>\s*)?(?:(?:static|inline|constexpr|virtual|explicit|extern|friend)\s+)*" + _NOT_CALLS + r"[\w:<>,&*\s]+?[\s&*]+(?P<name>[\w:~]+)\s*\([^()=;]*$"),
    ],
}
RULES["tsx"] = RULES["typescript"]
_COMPILED = {k: [(label, re.compile(p)) for label, p in rules] for k, rules in RULES.items()}

# what isn't code, by language: comments, strings and characters as each writes them; lifetimes, digits and preprocessor lines are taken with them
_STRING, _CHAR, _LINE = r"\"(?:\\.|[^\"\\\n])*\"", r"'(?:\\[^\n]?[^'\n]*|[^'\\\n])'", r"//[^\n]*"
_TOKENS = {
    "rust": [_LINE, r"/\*", r"b?r(?P<hashes>#*)\".*?\"(?P=hashes)", r"b?\"(?:\\.|[^\"\\])*\"", r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'", r"'\w+"],
    "go": [_LINE, r"/\*.*?\*/", r"`[^`]*`", _STRING, _CHAR],
    "java": [_LINE, r"/\*.*?\*/", r'"""(?:\\.|[^\\])*?"""', _STRING, _CHAR],
    "typescript": [_LINE, r"/\*.*?\*/", "`", _STRING, r"'(?:\\.|[^'\\\n])*'", r"(?<=[=(,:;!&|?\[{}\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"],
    "cpp": [r"(?m:^)[ \t]*\#(?:\\\r?\n|[^\n])*", _LINE, r"/\*.*?\*/", r"R\"(?P<mark>[^()\\\s]{0,16})\(.*?\)(?P=mark)\"", _STRING, r"\b\d[\w']*", _CHAR],
}
_TOKENS["tsx"] = _TOKENS["typescript"]
_NOISE = {k: re.compile("|".join(f"(?:{t})" for t in tokens), re.S) for k, tokens in _TOKENS.items()}
_NESTED, _TEMPLATE = re.compile(r"/\*|\*/"), re.compile(r"\\.|`|\$\{|[{}]", re.S)


def _nested_end(source: str, at: int) -> int:
    """Behind a comment that opens at `at` and may hold others."""
    depth = 0
    for m in _NESTED.finditer(source, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(source)


def _template_end(source: str, at: int) -> int:
    """Behind a template that opens at `at`; what is in ${} may hold templates."""
    open_ = ["`"]
    for m in _TEMPLATE.finditer(source, at + 1):
        if m[0] == "`":
            if open_[-1] == "`":
                open_.pop()
                if not open_:
                    return m.end()
            else:
                open_.append("`")
        elif m[0] == "${" and open_[-1] == "`":
            open_.append("{")
        elif m[0] in ("{", "${") and open_[-1] == "{":
            open_.append("{")
        elif m[0] == "}" and open_[-1] == "{":
            open_.pop()
    return len(source)


def bare_code(source: str, language: str) -> str:
    """The source with comments, strings of several lines, and brackets and semicolons within other strings and characters, as spaces; line breaks stay."""
    out, at = [], 0
    noise = _NOISE[language]
    while m := noise.search(source, at):
        a, b = m.span()
        opens = m[0]
        if opens == "/*":
            b = _nested_end(source, a)
        elif opens == "`":
            b = _template_end(source, a)
        part = source[a:b]
        text = part.lstrip(" \t")
        whole = "\n" in text or text.startswith(("//", "/*", "#", "`")) or language in ("typescript", "tsx") and text.startswith("/")
        out += [source[at:a], re.sub(r"[^\n]" if whole else r"[(){}\[\];]", " ", part)]
        at = b
    return "".join([*out, source[at:]])


def braced_symbols(source: str, language: str) -> list[Symbol]:
    """Definitions of a language with braces: heads by rules for lines, ends by matching braces outside comments and strings."""
    bare = bare_code(source, language)
    lines, originals = bare.split("\n"), source.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    marks = _Marks(bare)
    out: list[tuple[int, int, Symbol]] = []
    in_body: list[tuple[int, str]] = []  # end offset and label of open definitions
    for k, line in enumerate(lines):
        if not line.strip():
            continue
        in_body = [x for x in in_body if x[0] > starts[k]]
        inside = in_body[-1][1] if in_body else ""
        if inside in ("fn", "func", "method", "function", "constructor", "def") and language != "rust" and language not in ("typescript", "tsx"):
            continue  # statements of a body aren't definitions
        for label, pattern in _COMPILED[language]:
            m = pattern.match(line)
            if not m:
                continue
            if label == "method" and language in ("typescript", "tsx", "java") and inside not in ("class", "interface", "enum", "record", "@interface"):
                continue
            if label == "constructor" and inside not in ("class", "enum", "record"):
                continue
            begin = starts[k] + len(line) - len(line.lstrip())
            end, has_body = marks.end(_behind_parameters(bare, starts[k] + m.end("name")), language)
            if language == "cpp" and label in ("struct", "class", "union", "enum") and not has_body:
                break
            if language == "cpp" and label == "function" and inside in ("class", "struct", "union") and not has_body:
                label = "method" if re.match(r"(?:(?:virtual|static|inline|constexpr|explicit)\s+)*[\w:<>,&*]+[\w:<>,&*\s]*?[\s&*]+~?\w+\s*\(", line.strip()) else "function"
            last = bisect_left(starts, end + 1)
            out.append((begin, end, Symbol(m["name"], label, 1, k + 1, last, signature(originals[k]))))
            in_body.append((end, label))
            break
    open_: list[tuple[int, int]] = []  # that may hold what begins next
    for a, b, s in out:
        open_ = [x for x in open_ if x[1] >= a]
        s.depth = 1 + sum(1 for c, d in open_ if d >= b and (c, d) != (a, b))
        open_.append((a, b))
    return [s for _, _, s in out]


def _behind_parameters(bare: str, at: int) -> int:
    """Behind the type parameters that follow a name at `at`, if any; braces may stand in them."""
    if bare[at : at + 1] != "<":
        return at
    depth = 0
    for m in re.finditer(r"=>|[<>;]", bare[at:]):
        depth += {"<": 1, ">": -1}.get(m[0], 0)
        if m[0] == ";":
            break
        if not depth:
            return at + m.end()
    return at


class _Marks:
    """Brackets, semicolons and line breaks of a text, found once, with the brace that closes each."""

    def __init__(self, bare: str):
        found = [(m.start(), m[0]) for m in re.finditer(r"[()\[\]{};\n]", bare)]
        self.size = len(bare)
        self.at, self.kind = [x for x, _ in found], [c for _, c in found]
        self.round = [0]  # open round and square brackets before each mark
        self.close: dict[int, int] = {}
        open_: list[int] = []
        for k, c in enumerate(self.kind):
            self.round.append(self.round[-1] + (c in "([") - (c in ")]"))
            if c == "{":
                open_.append(k)
            elif c == "}" and open_:
                self.close[open_.pop()] = k

    def end(self, at: int, language: str) -> tuple[int, bool]:
        """The last offset of a definition whose name ends at `at`, and whether it has a body in braces; what is in braces is passed over."""
        k = bisect_left(self.at, at)
        before = self.round[k]
        while k < len(self.at):
            c, inner = self.kind[k], self.round[k] - before
            if c == "{":
                if k not in self.close:
                    break
                k = self.close[k]
                if self.round[k] <= before:
                    return self.at[k], True
            elif c == "}":
                return max(at, self.at[k] - 1), False
            elif c == ";" and inner <= 0:
                return self.at[k], False
            elif c == "\n" and language == "go" and inner <= 0:
                return self.at[k] - 1, False
            k += 1
        return self.size - 1, False


def outline(source: str, language: str) -> list[Symbol]:
    """Symbols in order of their start; an unknown language is a ConfigError."""
    source = source.removeprefix("﻿")
    if language == "python":
        return python_symbols(source)
    if language not in RULES:
        raise ConfigError(f"unknown language {language!r}")
    return braced_symbols(source, language)


def tree_lines(symbols: list[Symbol], depth: int | None = None) -> list[str]:
    """`start-end<TAB>signature` of each symbol down to a depth, two spaces for each level."""
    return [f"{s.start_line}-{s.end_line}\t{INDENT * (s.depth - 1)}{s.signature}" for s in symbols if depth is None or s.depth <= depth]


SYMBOLS = "rel string, name string, label string, depth int, start_line int, end_line int, signature string"


#: Files that a task takes to Python at a time, whatever the size of its batches.
FILES = 256


def symbols(files: DataFrame) -> DataFrame:
    """SYMBOLS of all files (rel, text) with a known extension; texts of others aren't read.

    Files are dealt to all tasks by path, since a task takes far longer to find
    symbols than to read them: a table of small bytes may come in one partition.
    """
    kinds = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    known = files.select("rel", "text", F.element_at(kinds, extension(F.col("rel"))).alias("language")).where("language is not null")
    names, types = zip(*(x.split() for x in SYMBOLS.split(", ")))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {"string": pa.string(), "int": pa.int32()}
        for batch in batches:
            for a in range(0, batch.num_rows, FILES):
                part = zip(*(c.to_pylist() for c in batch.slice(a, FILES).columns))
                rows = [(rel, s.name, s.label, s.depth, s.start_line, s.end_line, s.signature) for rel, text, language in part for s in outline(text or "", language)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind[t]) for x, t in zip(zip(*rows), types)], names)

    return known.repartition("rel").mapInArrow(f, SYMBOLS)
