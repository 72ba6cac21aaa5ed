"""Ignore files: the last rule that matches decides, and deeper files come later."""

from __future__ import annotations

import os
import re

from corpusloom.errors import ConfigError
from corpusloom.functions.globs import as_regex


def rule(line: str) -> tuple[str, bool, bool] | None:
    """(glob, whether it keeps, whether it is for folders only) of a line of an ignore file, or None where it has none."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r"))
    if not line or line.startswith("#"):
        return None
    keep = line.startswith("!")
    line = line[1:] if keep else line[1:] if line.startswith(("\\!", "\\#")) else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    glob = line if "/" in line else "**/" + line
    try:
        as_regex(glob)
    except ConfigError:
        return None
    return glob, keep, folder


class Rules:
    """Rules of one ignore file for paths below its folder."""

    def __init__(self, text: str):
        found = [x for x in map(rule, text.split("\n")) if x]
        self.rules = [(re.compile(as_regex(glob).replace(r"\z", r"\Z")), keep, folder) for glob, keep, folder in found]

    def verdict(self, rel: str, is_folder: bool) -> bool | None:
        """True: ignored, False: kept by a `!` rule, None: no rule matches."""
        for pattern, keep, folder in reversed(self.rules):
            if (is_folder or not folder) and pattern.search(rel):
                return not keep
        return None


NAMES = (".gitignore", ".ignore")


class Stack:
    """The rules that hold in a folder, from the top down."""

    def __init__(self, levels: tuple[tuple[str, Rules], ...] = ()):
        self.levels = levels

    def entered(self, folder: str) -> Stack:
        levels = self.levels
        for name in NAMES:
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    levels += ((folder, Rules(f.read())),)
            except OSError:
                continue
        return Stack(levels)

    def ignored(self, path: str, is_folder: bool) -> bool:
        for folder, rules in reversed(self.levels):
            v = rules.verdict(os.path.relpath(path, folder).replace(os.sep, "/"), is_folder)
            if v is not None:
                return v
        return False
