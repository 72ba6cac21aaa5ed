"""A folder as a stream: changed files alone are searched again, also after a restart from the checkpoint."""

import os

from corpusloom.operators.search import Search
from corpusloom.streaming.files import TreeStream, decoded_stream, tree_stream
from corpusloom.streaming.turns import stream_matches


def put(folder, rel, text, at):
    path = os.path.join(folder, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    os.utime(path, (at, at))


def test_changed_files_alone_come_again(spark, tmp_path):
    root, out, state = str(tmp_path / "tree"), str(tmp_path / "out"), str(tmp_path / "state")
    seen = set()

    def more():
        """What one more run from the checkpoint finds."""
        found = stream_matches(decoded_stream(tree_stream(spark, root)), Search("hit"))
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        rows = sorted((r.rel, r.line_no, r.line) for r in spark.read.parquet(out).collect())
        new = [r for r in rows if r not in seen]
        seen.update(rows)
        return new, len(rows)

    put(root, "a/one.txt", "x\nhit 1\n", 100)
    put(root, "two.txt", "hit 2", 100)
    put(root, ".gitignore", "*.log\n", 50)
    put(root, "c.log", "hit ignored", 100)
    put(root, "bin.dat", b"hit\0", 100)
    assert more() == ([("a/one.txt", 2, "hit 1"), ("two.txt", 1, "hit 2")], 2)
    assert more() == ([], 2)
    put(root, "two.txt", "hit 2 again", 200)
    put(root, "b/three.txt", "no\nhit 3", 150)
    assert more() == ([("b/three.txt", 2, "hit 3"), ("two.txt", 1, "hit 2 again")], 4)
    os.remove(os.path.join(root, "a/one.txt"))
    assert more() == ([], 4)


def test_offsets_order_files_by_time_and_name(tmp_path):
    root = str(tmp_path)
    r = TreeStream({"path": root})
    assert r.latestOffset() == r.initialOffset()
    for k in range(6):
        put(root, f"f{k}", "x", 10 + k // 2)
    end = r.latestOffset()
    assert end == {"mtime_ns": 12_000_000_000, "rel": "f5"}
    middle = {"mtime_ns": 11_000_000_000, "rel": "f2"}
    names = lambda a, b: sorted(rel for p in r.partitions(a, b) for _, rel in p.files)
    assert names(r.initialOffset(), middle) == ["f0", "f1", "f2"] and names(middle, end) == ["f3", "f4", "f5"]
    # one that has changed since its batch was planned comes with the next
    put(root, "f1", "y", 20)
    assert names(r.initialOffset(), middle) == ["f0", "f2"] and names(end, r.latestOffset()) == ["f1"]
