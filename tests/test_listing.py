"""Listings made on executors against those of the data source, and pages that open only the newest files."""

import os
import random

import pytest

from corpusloom.errors import ConfigError
from corpusloom.plans import engine
from corpusloom.plans.engine import Engine
from corpusloom.sources.listing import contents, listed, newest
from corpusloom.sources.tree import tree_files
from tests.test_ignored import planted


@pytest.mark.parametrize("seed", [5, 6])
def test_the_same_files_as_the_data_source(spark, tmp_path, seed):
    planted(str(tmp_path), random.Random(seed))
    os.makedirs(tmp_path / ".git" / "info")
    (tmp_path / ".git" / "info" / "exclude").write_text("m.tar.gz\n")
    (tmp_path / "odd name.txt").write_bytes(b"\xff\xfe\x00")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken")
    os.symlink(tmp_path / "odd name.txt", tmp_path / "link.txt")
    os.symlink(tmp_path, tmp_path / "loop")
    for policy in ("search", "all", "report"):
        for how in ({}, {"globs": ["**/*.log", "!a/**"]}, {"type": "rust"}):
            want = {(r.rel, r.mtime_ns, r.size, bytes(r.content)) for r in tree_files(spark, str(tmp_path), policy, True, **how).collect()}
            rows = contents(listed(spark, str(tmp_path), policy, **how)).collect()
            assert {(r.rel, r.mtime_ns, r.size, bytes(r.content)) for r in rows} == want and len(rows) == len(want)


def test_odd_folders(spark, tmp_path):
    assert listed(spark, str(tmp_path)).collect() == []
    with pytest.raises(ConfigError):
        listed(spark, str(tmp_path), "none")
    (tmp_path / "f").write_text("x")
    rows = listed(spark, str(tmp_path))
    os.remove(tmp_path / "f")
    assert [r.error[:10] for r in contents(rows).collect()] == ["unreadable"]


def test_files_by_age(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"f{k}").write_text("x")
        os.utime(tmp_path / f"f{k}", (k // 4, k // 4))
    rows = listed(spark, str(tmp_path))
    # four files are as old as the fifth newest
    assert sorted(r.rel for r in newest(rows, 5).collect()) == sorted(f"f{k}" for k in range(12, 20))
    assert newest(rows, 100).count() == 20


def test_a_page_opens_the_newest_files_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine, "NEWEST", (10, 40))
    for k in range(60):
        # older files can't be decoded: a page that opens one says so
        (tmp_path / f"f{k:02d}").write_bytes(b"hit\n" * 2 if k >= 30 else b"hit \xff\xe9\n")
        os.utime(tmp_path / f"f{k:02d}", (k, k))
    e = Engine(spark, str(tmp_path), env={})
    first = e.search("hit", head_limit=5)
    assert first.text.startswith("f59\nf58\nf57\nf56\nf55\n") and first.skip_report is None and first.terminal.total is None
    again = e.search("hit", head_limit=5, offset=5)
    assert again.text.startswith("f54\n") and again.skip_report["files"] == 10  # among the 40 newest
    content = e.search("hit", output_mode="content", head_limit=3)
    assert content.skip_report is None and content.text.count(": hit") == 3 and content.next_call["arguments"]["offset"] == 3
    rest = e.search("hit", head_limit=0)
    assert rest.terminal.total == 30 and rest.skip_report["files"] == 30
    assert e.search("hit", output_mode="summary").skip_report["files"] == 30
