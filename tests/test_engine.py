import json
import os
import re

import pytest

from corpusloom.errors import ConfigError, EncodingError
from corpusloom.operators import intervals, outline, search, turns
from corpusloom.operators.pool import Pool, for_host, stub
from corpusloom.operators.search import Search
from corpusloom.plans.budget import BudgetTooSmall, largest_fitting, resolve
from corpusloom.plans.engine import Engine, window
from corpusloom.sources.corpus import Corpus
from corpusloom.sources.paths import from_windows, resolved


def corpus(spark, files):
    rows = [(rel, at, len(text.encode()), text) for rel, at, text in files]
    return Corpus(spark.createDataFrame(rows, "rel string, mtime_ns long, size long, text string"))


@pytest.fixture
def tree(tmp_path):
    def put(rel, data, at=1000):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())
        os.utime(p, (at, at))

    put("a.txt", "alpha\nneedle one\nomega\n", 200)
    put("m.txt", "needle\nneedle needle\n", 300)
    put("z.txt", "x\r\nneedle\r\n", 100)
    put(".hidden", "needle\n", 50)
    put("_under.py", "class A:\n    def f(self):\n        pass\n", 40)
    put(".gitignore", "ignored/\n*.log\n!keep.log\n", 30)
    put("ignored/x.txt", "needle\n")
    put("b.log", "needle\n")
    put("keep.log", "needle\n", 20)
    put(".git/config", "needle\n")
    put("bin.dat", b"needle\0")
    put("odd.dat", b"\xe9")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken")
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    return tmp_path


def test_search_pages(spark, tree):
    e = Engine(spark, str(tree), env={})
    p = e.search("needle")
    assert p.text.split("\n")[0] == "m.txt" and {"a.txt", "link.txt", "z.txt", ".hidden", "keep.log"} <= set(p.text.split("\n"))
    assert p.terminal.total == 6 and p.skip_report["files"] == 1 and p.skip_report["details"][0]["path"] == "odd.dat"
    p = e.search("needle", output_mode="count", head_limit=2)
    assert p.text.startswith("m.txt:3\n") and p.terminal.total is None and p.truncated
    assert p.next_call["arguments"]["offset"] == 2
    assert "8 occurrences in 6 files" in e.search("needle", output_mode="summary").wire()
    assert e.search("nothing here").terminal.total == 0
    p = e.search("needle", offset=10)
    assert p.text is None and p.terminal.total == 6
    p = e.search("needle", path="a.txt", output_mode="content", context=1)
    assert "1- alpha\n2: needle one\n3- omega" in p.text
    assert "1:needle" in e.search("needle", path="m.txt", output_mode="content", only_matching=True).text
    with pytest.raises(ConfigError):
        e.search("needle", path="gone")
    with pytest.raises(ConfigError):
        e.search("needle", encoding="gbk")
    assert json.loads(p.envelope())["terminal"]["state"] == "complete"


def test_next_pages_ask_for_the_same(spark, tree):
    e = Engine(spark, str(tree), env={})
    (tree / "late.dat").write_bytes("針".encode("gbk") + b" needle\n")
    p = e.search("needle", fallback_encoding="gbk", line_numbers=False, head_limit=1, output_mode="content", glob=["*.txt", "*.dat"])
    args = p.next_call["arguments"]
    assert args == {"pattern": "needle", "fallback_encoding": "gbk", "line_numbers": False, "head_limit": 1, "output_mode": "content", "glob": ["*.txt", "*.dat"], "offset": 1}
    pages = [p.text]
    while p.next_call:
        p = e.search(**p.next_call["arguments"])
        pages.append(p.text)
    assert sum("針 needle" in x for x in pages) == 1 and len(pages) == 6


def test_a_single_file_has_no_header(spark, tree):
    e = Engine(spark, str(tree), env={})
    assert e.search("needle", path="m.txt", output_mode="content").text.startswith("1: needle\n2: needle needle\n")
    assert e.search("needle", path="m.txt", output_mode="content", only_matching=True).text.startswith("1:needle\n2:needle\n")
    assert e.search("needle", output_mode="content").text.startswith("m.txt\n1: needle")


def test_files_that_path_filters_drop_are_not_opened(spark, tree):
    e = Engine(spark, str(tree), env={})
    assert e.search("needle", glob="*.txt").skip_report is None and e.search("needle").skip_report["files"] == 1
    assert e.search("needle", type="txt").terminal.total == 4


def test_files_with_too_much_to_show_are_skipped_with_a_reason(spark, monkeypatch):
    monkeypatch.setattr(search, "CAPTURED", 20)
    c = corpus(spark, [("big", 2, "hit and much more\nhit again\n"), ("small", 1, "hit\n")])
    p = Engine(spark, "/", env={}).search_corpus(c, Search("hit", output_mode="content"))
    assert p.terminal.total == 1 and p.skip_report["details"] == [{"path": "big", "reason": "its matching lines have 26 bytes, more than 20"}]


def test_patterns_that_match_nothing_at_all(spark):
    c = corpus(spark, [("f", 1, "baac")])
    s = Search("a*", output_mode="count")
    assert search.counts(c, s).first().occurrences == 3
    assert search.counts(c, Search("a*", output_mode="count", multiline=True)).first().occurrences == 3
    found = search.occurrences(c, Search("a*", output_mode="content", only_matching=True)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.matched) for r in found] == [(1, ""), (2, "aa"), (3, "")]
    found = search.occurrences(c, Search("a*", output_mode="content", multiline=True)).orderBy("ordinal").collect()
    assert [(r.line_no, r.matched) for r in found] == [(1, ""), (1, "aa"), (1, "")]


def test_pages_stay_within_the_budget_and_add_up(spark):
    c = corpus(spark, [(f"f{k:03d}", 1000 - k, "hit\n" * (k % 3 + 1)) for k in range(40)])
    e = Engine(spark, "/", env={"CORPUSLOOM_BUDGET": "200"})
    shown, offset = [], 0
    while True:
        p = e.search_corpus(c, Search("hit"), offset=offset, budget=200)
        assert p.returned <= 200
        shown += [x for x in p.text.split("\n") if x.startswith("f")]
        if not p.next_call:
            break
        offset = p.next_call["arguments"]["offset"]
    assert shown == [f"f{k:03d}" for k in range(40)]
    with pytest.raises(BudgetTooSmall):
        e.search_corpus(c, Search("hit"), budget=3)


def test_order_and_anchors(spark):
    c = corpus(spark, [("a", 200, "foo"), ("m", 300, "foo"), ("z", 100, "foo"), ("B", 50, "foo"), ("_", 50, "foo")])
    assert [r.rel for r in search.ordered(c, Search("foo")).collect()] == ["m", "a", "z", "B", "_"]
    c = corpus(spark, [("x", 1, "foo\r\nbar foo\r\nfoo\nbaz\n")])
    assert [r.line_no for r in search.ordered(c, Search("foo$", output_mode="content")).collect()] == [1, 2, 3]
    assert search.counts(c, Search("foo\nbar", output_mode="count", multiline=True)).first().occurrences == 1
    for n in (1, 4, 16):
        again = Corpus(c.files.repartition(n))
        assert search.summary(again, Search("foo", output_mode="summary")).first().occurrences == 3


def test_context_blocks(spark):
    c = corpus(spark, [("g", 1, "1\nhit\n3\n4\n5\nhit\n7")])
    rows = [(r.line_no, r.is_match, r.block) for r in search.ordered(c, Search("hit", output_mode="content", context=1)).collect()]
    assert rows == [(1, False, 1), (2, True, 1), (3, False, 1), (5, False, 2), (6, True, 2), (7, False, 2)]


def test_glob_pages(spark, tree):
    e = Engine(spark, str(tree), env={})
    assert "a.txt" in e.glob("*.txt").text and "ignored" not in e.glob("**/*.txt").text
    assert "ignored/x.txt" in e.glob("**/*.txt", filter_mode="all").text and ".git" not in e.glob("**", filter_mode="all").text.replace(".gitignore", "")
    p = e.glob("*.txt", sort="path", limit=2)
    assert p.text.startswith("a.txt\nlink.txt\n") and p.terminal.total == 4 and p.next_call["arguments"]["offset"] == 2
    assert '{"path":"z.txt","bytes":11,"modified":"1970-01-01T00:01:40.000000000Z"}' in e.glob("z.txt", output_mode="details").text
    assert e.glob("*.none").text and e.glob("*.none").terminal.total == 0
    with pytest.raises(ConfigError):
        e.glob("*", limit=0)


def test_lists_of_globs_and_vetoes(spark, tree):
    e = Engine(spark, str(tree), env={})
    assert e.glob(["*.txt", "*.log", "!m*"], sort="path").text.split("\n")[:4] == ["a.txt", "keep.log", "link.txt", "z.txt"]
    with pytest.raises(ConfigError):
        e.glob(["!"])


def test_batches_go_on_inside_a_file(spark, tree):
    (tree / "long.txt").write_text("".join(f"line {k} of many\n" for k in range(60)))
    e = Engine(spark, str(tree), env={"CORPUSLOOM_BUDGET": "400"})
    files, seen = [{"path": "a.txt"}, {"path": "long.txt", "limit": 50}, {"path": "m.txt"}], []
    while files:
        p = e.read(files=files)
        assert p.returned <= 400
        seen += [x for x in p.text.split("\n") if "\tline" in x]
        files = p.next_call["files"] if p.next_call else None
    assert seen == [f"{k + 1}\tline {k} of many" for k in range(50)]
    with pytest.raises(ConfigError):
        e.read(files=[{"path": "a.txt"}, {"path": "./a.txt"}])
    (tree / "wide.txt").write_text("x" * 3000)
    assert "(line of 3000 characters cut)" in Engine(spark, str(tree), env={}).read(files=[{"path": "wide.txt"}]).text


def test_read_pages(spark, tree):
    e = Engine(spark, str(tree), env={})
    assert e.read("z.txt").text.startswith("1\tx\n2\tneedle\n")
    p = e.read("a.txt", offset=2, limit=1)
    assert "2\tneedle one" in p.text and p.terminal.state == "complete" and p.terminal.total == 3
    assert "behind the end" in e.read("a.txt", offset=9).text
    with pytest.raises(EncodingError):
        e.read("odd.dat")
    p = e.read(files=[{"path": "a.txt"}, {"path": "gone.txt"}, {"path": "z.txt", "offset": 2}])
    assert "=== a.txt (lines 1-3 of 3) ===" in p.text and "Error" in p.text and "2\tneedle" in p.text
    for bad in ({}, {"file_path": "a.txt", "files": []}, {"files": []}, {"files": [{"path": "a.txt"}] * 2}, {"files": [{"path": str(k)} for k in range(33)]}):
        with pytest.raises(ConfigError):
            e.read(**bad)
    small = Engine(spark, str(tree), env={"CORPUSLOOM_BUDGET": "80"})
    (tree / "long.txt").write_text("".join(f"line {k}\n" for k in range(30)))
    p = small.read("long.txt")
    assert p.truncated and p.next_call["offset"] == p.terminal.shown_to + 1


def test_outline_and_reports(spark, tree):
    e = Engine(spark, str(tree), env={})
    assert e.outline("_under.py").text == "1-3\tclass A\n2-3\t  def f(self)"
    with pytest.raises(ConfigError):
        e.outline("a.txt")
    assert "no index" in e.status() and "txt: " in e.index() and "hidden" not in e.index()


def test_outlines_by_language():
    got = lambda s, lang: [(x.label, x.name, x.depth, x.start_line, x.end_line) for x in outline.outline(s, lang)]
    assert got("def f(:\n  pass\nclass B:\n  def g(self):\n    pass\n", "python") == [("def", "f", 1, 1, 2), ("class", "B", 1, 3, 5), ("def", "g", 2, 4, 5)]
    assert got("pub mod a {\n  fn b() {}\n}\nconst X: u8 = 1;\n", "rust") == [("mod", "a", 1, 1, 3), ("fn", "b", 2, 2, 2), ("const", "X", 1, 4, 4)]
    assert got("package p\ntype T struct {\n}\nfunc (t T) M() {\n}\nfunc F() {\n}\n", "go") == [("type", "T", 1, 2, 3), ("method", "M", 1, 4, 5), ("func", "F", 1, 6, 7)]
    assert got("class A {\n  A() {\n  }\n  int f(int x) {\n    return g(x);\n  }\n}\n", "java") == [("class", "A", 1, 1, 7), ("constructor", "A", 2, 2, 3), ("method", "f", 2, 4, 6)]
    assert got("export class A {\n  f(): void {\n  }\n}\ntype T = string;\nfunction g() {\n}\n", "typescript") == [("class", "A", 1, 1, 4), ("method", "f", 2, 2, 3), ("type", "T", 1, 5, 5), ("function", "g", 1, 6, 7)]
    assert got("struct F;\nstruct S {\n  int f();\n};\nint g(int a) {\n  return 1;\n}\n", "cpp") == [("struct", "S", 1, 2, 4), ("method", "f", 2, 3, 3), ("function", "g", 1, 5, 7)]
    assert outline.outline("﻿x = 1\n", "python") == []


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 7, 8), ("b", 2, 9), ("b", 3, 4)], "k string, start_line int, end_line int")
    assert sorted(tuple(r) for r in intervals.merged(rows, "k").collect()) == [("a", 1, 5, 2), ("a", 7, 8, 1), ("b", 2, 9, 2)]


def test_turns(spark):
    rows = spark.sql("select 'k' k, id call_id, timestamp_seconds(s) at from values (1, 0.0D), (2, 0.5D), (3, 1.5D), (4, 2.4D) t(id, s)")
    assert [r.turn for r in turns.turns(rows, "k", "at", 1).orderBy("call_id").collect()] == [1, 1, 2, 2]


def test_stream_matches(spark, tmp_path):
    from corpusloom.streaming.turns import stream_matches

    folder = tmp_path / "in"
    spark.createDataFrame([("a", "x\nhit 1\n"), ("b", "hit 2\r\nhit 3")], "rel string, text string").write.parquet(str(folder))
    out = stream_matches(spark.readStream.schema("rel string, text string").parquet(str(folder)), Search("hit"))
    q = out.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("found").collect())) == [("a", 2, "hit 1"), ("b", 1, "hit 2"), ("b", 2, "hit 3")]


def test_paths_outside_the_root_are_absolute(spark, tree, tmp_path_factory):
    other = tmp_path_factory.mktemp("other")
    (other / "f.txt").write_text("needle\n")
    e = Engine(spark, str(tree), env={})
    assert e.search("needle", path=str(other)).text.startswith(f"{other}/f.txt\n")
    assert e.glob("*.txt", path=str(other)).text.startswith(f"{other}/f.txt\n")


def test_files_that_change_while_they_are_read(tmp_path, monkeypatch):
    from corpusloom.errors import FileChanged
    from corpusloom.sources import tree as source

    (tmp_path / "f").write_text("abc")
    real = os.stat
    monkeypatch.setattr(source.os, "stat", lambda p: type("S", (), {"st_mtime_ns": 1, "st_size": 3})() if str(p).endswith("f") else real(p))
    with pytest.raises(FileChanged):
        source.sealed(str(tmp_path / "f"))


def test_pool():
    now = [0.0]
    p = Pool(lambda: now[0])
    calls = [p.begin() for _ in range(3)]
    assert [c.claim(9000) for c in calls] == [3000, 3000, 3000]
    late = p.begin()
    assert late.claim(9000) == 128
    for c in (*calls, late):
        c.complete(c.granted)
    now[0] = 0.9
    assert p.begin().generation == 1
    q = for_host("Codex CLI", lambda: now[0])
    assert q.cap == 13_599 and for_host("other", lambda: 0).cap is None
    with q.begin() as c:
        c.claim(100)
    assert q.reserved == 0
    assert stub(3, len) == "" and len(stub(500, len)) > 30


def test_calls_share_the_pool_of_a_turn(spark, tree):
    now = [0.0]
    pool = Pool(lambda: now[0], pool=500)
    (tree / "wide.txt").write_text("".join(f"line {k}\n" for k in range(100)))
    e = Engine(spark, str(tree), env={}, pool=pool)
    first = e.call("read", file_path="wide.txt")
    assert first.truncated and 300 < first.returned <= 500 and pool.spent == first.returned and not pool.active
    second = e.call("read", file_path="wide.txt", offset=5)
    assert second.next_call == {"tool": "read", "arguments": {"file_path": "wide.txt", "offset": 5}} and second.returned <= 128
    now[0] = 2.0
    assert e.call("read", file_path="a.txt").terminal.state == "complete" and pool.generation == 2
    with pytest.raises(ConfigError):
        e.call("status")
    assert Engine(spark, str(tree), env={}).call("read", file_path="a.txt").text.startswith("1\talpha")


def test_budgets():
    assert resolve("read", {}) == 8500 and resolve("read", {"CORPUSLOOM_BUDGET": "10"}) == 10
    for env in ({"CORPUSLOOM_BUDGET": "x"}, {"CORPUSLOOM_BUDGET": "5", "CORPUSLOOM_BUDGET_READ": "6"}):
        with pytest.raises(ConfigError):
            resolve("read", env)
    assert largest_fitting(10, lambda k: k <= 7) == 7 and largest_fitting(10, lambda k: False) == 0


def test_long_lines():
    assert window("x" * 500, [(0, 1)]) == "x" * 500
    cut = window("a" * 300 + "hit" + "b" * 300, [(300, 3)])
    assert cut.startswith("…") and "hit" in cut and "603 bytes" in cut


def test_paths(tmp_path):
    assert resolved("/a/b", "../c/./d") == "/a/c/d" and resolved("/a", "../../..") == "/"
    assert from_windows("C:\\x\\y") == "/mnt/c/x/y" and from_windows("\\\\wsl$\\U\\home\\me") == "/home/me"
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "r").write_text("")
    assert resolved(str(tmp_path), "q\\r") == str(tmp_path / "q" / "r")


def test_queries_have_names_and_columns(spark):
    from corpusloom.plans import queries as q

    assert set(q.oracle_sql()) <= set(q.queries())
    for f in q.queries().values():
        assert f(spark, "/root/testdata/sf0.001").columns


def test_multiline_places(spark):
    c = corpus(spark, [("x", 1, "a\r\nfoo\r\nbar\nfoo\nbar foo\nbar\n")])
    found = search.occurrences(c, Search("foo\nbar", output_mode="content", multiline=True))
    assert [(r.line_no, r.ordinal) for r in found.orderBy("ordinal").collect()] == [(2, 1), (4, 2), (5, 3)]
    assert sorted((r.ordinal, r.line_no) for r in search.touched_lines(found).collect()) == [(1, 2), (1, 3), (2, 4), (2, 5), (3, 5), (3, 6)]


def test_notes_of_encodings(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes(b"\xff\xfe" + "needle\n".encode("utf-16-le"))
    (tmp_path / "w.txt").write_bytes("needle é".encode("cp1252"))
    e = Engine(spark, str(tmp_path), env={})
    p = e.search("needle")
    assert p.text.startswith("u.txt\n") and "Decoded from utf-16-le." in p.text and p.skip_report["files"] == 1
    p = e.search("needle", fallback_encoding="windows-1252")
    assert p.terminal.total == 2 and "Decoded from windows-1252." in p.text and "1 by the fallback" in p.text


def test_schemas_are_portable():
    from corpusloom.plans.schemas import TOOLS, portable

    assert all(map(portable, TOOLS.values()))


def test_a_page_behind_a_file_that_is_skipped_for_its_context(spark, monkeypatch):
    monkeypatch.setattr(search, "CAPTURED", 30)
    c = corpus(spark, [("new", 9, "long line before\nhit\nlong line behind\n"), ("old", 1, "hit\n\nhit\n")])
    e = Engine(spark, "/", env={})
    s = Search("hit", output_mode="content", context=3)
    first = e.search_corpus(c, s, head_limit=1)
    assert "old" in first.text and "new" not in first.text and first.skip_report["files"] == 1
    assert first.next_call["arguments"]["offset"] == 1
    second = e.search_corpus(c, s, head_limit=1, offset=1)
    assert "3: hit" in second.text and second.next_call is None
    assert e.search_corpus(c, s, head_limit=1, offset=5).terminal.total == 2


def test_context_shrinks_before_it_goes(spark):
    lines = [f"line {i} of some words" for i in range(41)]
    lines[20] = "the hit"
    c = corpus(spark, [("f", 1, "\n".join(lines))])
    e = Engine(spark, "/", env={})
    sizes = {}
    for budget in (2000, 300, 150, 60):
        p = e.search_corpus(c, Search("hit", output_mode="content", context=20), budget=budget)
        assert p.returned <= budget and "21: the hit" in p.text
        sizes[budget] = sum(x.split("-")[0].isdigit() for x in p.text.split("\n"))
    assert sizes[2000] == 40 and 0 < sizes[150] < sizes[300] < 40 and sizes[60] == 0
    # as much as fits: with one more line on each side it doesn't
    p = e.search_corpus(c, Search("hit", output_mode="content", context=sizes[300] // 2 + 1), budget=5000)
    assert p.returned > 300


def test_read_pages_by_tokens(spark, tmp_path):
    import public_tokenizers

    from corpusloom.functions.tokens import TokenCounter

    text = "".join(f"word{i % 7} don't\n" + "\n" * (i % 4) for i in range(300))
    (tmp_path / "t.txt").write_text(text)
    count = TokenCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    e = Engine(spark, str(tmp_path), count, env={"CORPUSLOOM_BUDGET": "200"})
    seen, call = [], {"file_path": "t.txt"}
    while call:
        p = e.read(**call)
        assert p.returned == count(p.text) <= 200
        seen += [x.split("\t", 1)[1] for x in p.text.split("\n") if "\t" in x]
        call = p.next_call
    assert seen == text.split("\n")[:-1]


def test_matches_over_lines_of_any_text(spark):
    text = "x\nab\nab\nc ab\nab\n"
    rows = [("f", 1, text), ("f", 2, "ab\nab"), ("g", 3, "none"), ("h", 4, "\n\nab\n")]
    found = search.occurrences(corpus(spark, rows), Search(r"b.*?\n|a", output_mode="content", multiline=True)).collect()
    want = []
    for rel, at, t in rows:
        for k, m in enumerate(re.finditer(r"b.*?\n|a", t, re.S), 1):
            want.append((rel, at, 1 + t[: m.start()].count("\n"), k, m[0]))
    assert sorted(tuple(r) for r in found) == sorted(want)


@pytest.mark.parametrize("how", [{"only_matching": True}, {"multiline": True}, {"multiline": True, "only_matching": True}, {}])
def test_files_with_too_many_matches_are_skipped_in_every_mode(spark, monkeypatch, how):
    monkeypatch.setattr(search, "CAPTURED", 10)
    c = corpus(spark, [("big", 2, "hit hit hit\nhit\n"), ("small", 1, "hit\n\nhit\n")])
    p = Engine(spark, "/", env={}).search_corpus(c, Search("hit", output_mode="content", **how))
    assert p.terminal.total == 2 and [d["path"] for d in p.skip_report["details"]] == ["big"] and "big" not in p.text
    assert Engine(spark, "/", env={}).search_corpus(c, Search("hit", output_mode="count", **how)).terminal.total == 2


def test_a_match_that_is_longer_than_its_window():
    line = "x" * 300 + "y" * 3000 + "x" * 300 + "y"
    shown = window(line, [(300, 3000), (3600, 1)])
    assert shown.startswith("…yyy") and shown.endswith("… (match of 3000 characters cut) (line of 3601 bytes, 1 match beyond)")
    assert len(shown) < 2100
    # one that fits is shown whole, with what is around it
    assert window("x" * 900 + "hit" + "x" * 900, [(900, 3)]) == "…" + "x" * 100 + "hit" + "x" * 100 + "… (line of 1803 bytes)"


def test_how_a_page_is_given(spark, tree):
    p = Engine(spark, str(tree), env={}).read("a.txt")
    assert p.wire() == p.wire("text", {"CORPUSLOOM_WIRE": "envelope"}) == p.text
    assert json.loads(p.wire(env={"CORPUSLOOM_WIRE": "envelope"}))["text"] == p.text
    with pytest.raises(ConfigError):
        p.wire(env={"CORPUSLOOM_WIRE": "other"})


def test_files_that_are_too_large_to_count_lines_of(spark, tree, monkeypatch):
    from corpusloom.operators import read

    monkeypatch.setattr(read, "COUNTED", 5)
    e = Engine(spark, str(tree), env={})
    p = e.read("a.txt", limit=2)
    assert p.terminal.total is None and "lines 1-2 shown" in p.text
    many = e.read(files=[{"path": "a.txt", "limit": 1}, {"path": "m.txt"}])
    assert "=== a.txt (lines 1-1) ===" in many.text and "=== m.txt (lines 1-2) ===" in many.text
    monkeypatch.undo()
    assert "lines 1-3 of 3 shown" in e.read("a.txt").text


def test_a_page_that_is_counted_wrongly_is_an_error(spark, tree, monkeypatch):
    from corpusloom.plans import engine

    monkeypatch.setattr(engine.PrefixCounter, "total", lambda self, tail="": 1)
    with pytest.raises(RuntimeError):
        Engine(spark, str(tree), env={}).read("a.txt")
