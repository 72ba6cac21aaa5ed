"""Parameters of the tools as JSON Schema, in the few keywords that all hosts know."""

from __future__ import annotations

from corpusloom.operators.search import MODES

KEYWORDS = {"type", "properties", "required", "items", "enum", "default", "description", "minimum", "maximum", "minItems", "maxItems"}


def _text(about: str, **more) -> dict:
    return {"type": "string", "description": about, **more}


def _number(about: str, **more) -> dict:
    return {"type": "integer", "description": about, "minimum": 0, **more}


def _flag(about: str, default: bool = False) -> dict:
    return {"type": "boolean", "description": about, "default": default}


_ENTRY = {"type": "object", "properties": {"path": _text("file"), "offset": _number("first line, from 1"), "limit": _number("lines"), "encoding": _text("encoding of the file")}, "required": ["path"]}

TOOLS = {
    "search": {
        "type": "object",
        "properties": {
            "pattern": _text("regular expression without lookaround or backreferences"),
            "path": _text("folder or file; the root by default"),
            "glob": {"type": "array", "items": {"type": "string"}, "description": "globs that keep paths, or with ! in front drop them"},
            "type": _text("named file type"),
            "output_mode": _text("what is returned", enum=list(MODES), default=MODES[0]),
            "case_insensitive": _flag("ignore case"),
            "line_numbers": _flag("number lines of content", True),
            "only_matching": _flag("matches instead of lines"),
            "before_context": _number("lines before", default=0),
            "after_context": _number("lines behind", default=0),
            "context": _number("lines on both sides, instead of the two"),
            "multiline": _flag("matches may span lines"),
            "head_limit": _number("entries of a page; 0: as many as the budget takes", default=250),
            "offset": _number("entries to leave out", default=0),
            "encoding": _text("encoding of a file"),
            "fallback_encoding": _text("encoding of what can't be decoded in a folder"),
        },
        "required": ["pattern"],
    },
    "glob": {
        "type": "object",
        "properties": {
            "pattern": {"type": "array", "items": {"type": "string"}, "description": "globs that keep paths, or with ! in front drop them; one may be given as it is"},
            "path": _text("folder; the root by default"),
            "filter_mode": _text("whether ignore rules hold", enum=["ignore", "all"], default="ignore"),
            "sort": _text("order", enum=["modified", "path"], default="modified"),
            "output_mode": _text("paths, or JSON lines", enum=["paths", "details"], default="paths"),
            "offset": _number("paths to leave out", default=0),
            "limit": _number("paths of a page", default=100, minimum=1, maximum=1000),
        },
        "required": ["pattern"],
    },
    "read": {
        "type": "object",
        "properties": {
            "file_path": _text("one file"),
            "files": {"type": "array", "items": _ENTRY, "minItems": 1, "maxItems": 32, "description": "several files, instead of one"},
            "offset": _number("first line, from 1"),
            "limit": _number("lines"),
            "encoding": _text("encoding of the file"),
        },
        "required": [],
    },
    "outline": {"type": "object", "properties": {"path": _text("source file"), "depth": _number("levels", default=2)}, "required": ["path"]},
}


def portable(schema: dict) -> bool:
    """Whether a schema uses KEYWORDS alone."""
    inner = [*schema.get("properties", {}).values()] + ([schema["items"]] if "items" in schema else [])
    return set(schema) <= KEYWORDS and all(map(portable, inner))
