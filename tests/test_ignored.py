import os
import random

import pytest

from corpusloom.operators import ignored
from corpusloom.sources.ignore import Stack
from corpusloom.sources.tree import tree_files

NAMES = ["a", "b", "target", "x.log", "keep.log", "m.tar.gz", "n.gz", ".env", "b.txt", "é.rs", "#odd", "sp ace"]
LINES = ["*.log", "!keep.log", "target/", "/a", "b/", "!b", "*.tar.gz", "*.gz", "a/**", "!a/b", "**/b/x.log", "[ab]", "?.txt", "{x,n}.*", ".*", "!.env", "# a comment", "", "  ", r"\#odd", "sp ace", "*", "!*/", "target", "*.txt  ", "[", "a/b/", "é.rs", "/*/b"]


def planted(root, rng):
    paths = set()
    while len(paths) < 120:
        paths.add("/".join([rng.choice(["a", "b", "target", "c"]) for _ in range(rng.randrange(4))] + [rng.choice(NAMES)]))
    for p in sorted(paths):
        full = os.path.join(root, p)
        if os.path.isdir(full) or any(os.path.isfile(os.path.join(root, *p.split("/")[:k])) for k in range(1, p.count("/") + 1)):
            continue
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write("x")
    for folder, _, _ in list(os.walk(root)):
        for name in (".gitignore", ".ignore"):
            if rng.random() < 0.5:
                with open(os.path.join(folder, name), "w") as f:
                    f.write("\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 6))))


@pytest.mark.parametrize("seed, limit", [(1, 20_000), (2, 0), (3, 20_000), (4, 20_000)])
def test_the_join_decides_as_the_walk_does(spark, tmp_path, monkeypatch, seed, limit):
    monkeypatch.setattr(ignored, "BROADCAST_RULES", limit)
    planted(str(tmp_path), random.Random(seed))
    every = tree_files(spark, str(tmp_path), "all")
    files = [(r.rel, bytes(r.content).decode()) for r in every.collect()]
    kept = {r.rel for r in tree_files(spark, str(tmp_path), "search", content=False).collect()}
    table = spark.createDataFrame(files, "rel string, text string")
    got = ignored.verdicts(table, ignored.rules_of(ignored.lines_of(table))).collect()
    assert {r.rel for r in got} == {rel for rel, _ in files} and len(got) == len(files)
    assert {r.rel for r in got if not r.ignored} == kept
    assert 5 < len(kept) < len(files)


def test_odd_tables(spark):
    paths = spark.createDataFrame([("a/x.log",), ("a/x.log",), (None,), ("",)], "rel string")
    lines = lambda rows: spark.createDataFrame(rows, "folder string, rank int, line_no long, line string")
    found = lambda rows: sorted(((r.rel, r.ignored) for r in ignored.verdicts(paths, ignored.rules_of(lines(rows))).collect()), key=str)
    assert found([]) == [("", False), ("a/x.log", False), ("a/x.log", False), (None, False)]
    assert found([("", 1, 1, "*.log"), ("", 1, 2, None)]) == [("", False), ("a/x.log", True), ("a/x.log", True), (None, False)]
    # a folder's own rules are for what is in it, and a later file's come after
    assert found([("a", 1, 1, "/a"), ("a", 1, 2, "*.log"), ("a", 2, 1, "!x.*")]) == found([])


def test_how_globs_are_looked_up():
    assert [ignored.keyed(g) for g in ("**/target", "**/*.log", "**/*.tar.gz", "a/b", "**/x*", "**/*", "**/[ab]")] == [("name", "target"), ("ending", ".log"), ("ending", ".tar.gz"), ("any", ""), ("any", ""), ("any", ""), ("any", "")]


def test_stack_still_reads_rules(tmp_path):
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n")
    s = Stack().entered(str(tmp_path))
    assert s.ignored(str(tmp_path / "a.log"), False) and not s.ignored(str(tmp_path / "keep.log"), False)
