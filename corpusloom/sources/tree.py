"""Folders of files as a Spark data source, dotfiles included.

Format "corpus_tree" with options path, policy (search, all or report) and
content (true by default), globs (a JSON list) and type. Names are listed once, on the driver, and files are
dealt to tasks by their bytes; conditions on paths are judged before a file is
read. Spark's own readers leave out names that begin with a dot or an underscore.
"""

from __future__ import annotations

import contextlib
import json
import operator
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.errors import ConfigError, FileChanged
from corpusloom.functions.decode import decode_files
from corpusloom.functions.globs import TYPES, as_list, glob_filter, wanted
from corpusloom.sources.corpus import Corpus
from corpusloom.sources.ignore import NAMES, Rules, Stack

SCHEMA = "path string, rel string, mtime_ns long, size long, content binary, error string"
REPORT_BYTES, PRUNED = 1 << 20, ".git"
POLICIES = ("search", "all", "report")


def sealed(path: str) -> tuple[bytes, os.stat_result]:
    """A file's bytes; it must not change while it is read."""
    with open(path, "rb") as f:
        before = os.fstat(f.fileno())
        data = f.read()
        after = os.stat(path)
    if (before.st_mtime_ns, before.st_size) != (after.st_mtime_ns, after.st_size) or len(data) != after.st_size:
        raise FileChanged("the file changed while it was read")
    return data, after


def walked(root: str, top: str, stack: Stack, policy: str) -> Iterator[tuple[str, str | None]]:
    """(path, error) of the files at and below an entry of root; links to files count, links to folders and broken ones don't."""
    name = os.path.basename(top)
    if policy == "report" and name.startswith("."):
        return
    if os.path.islink(top):
        if os.path.isfile(top) and (policy == "all" or not stack.ignored(top, False)):
            yield top, None
        return
    if not os.path.isdir(top):
        if os.path.lexists(top) and (policy == "all" or not stack.ignored(top, False)):
            yield top, None
        return
    if name == PRUNED or policy != "all" and stack.ignored(top, True):
        return
    inner = stack.entered(top)
    try:
        entries = sorted(os.listdir(top))
    except OSError as e:
        yield top, f"unreachable: {e.strerror}"
        return
    for x in entries:
        yield from walked(root, os.path.join(top, x), inner, policy)


#: Bytes of files that one task reads, about, and what a file counts besides its bytes.
PART_BYTES, FILE_BYTES = 32 << 20, 4 << 10
#: Filters on paths by the names of their classes.
_TESTS = {"EqualTo": "equal", "In": "among", "StringStartsWith": "begins", "StringEndsWith": "ends", "StringContains": "holds"}
_OPERATIONS = {"equal": operator.eq, "among": lambda x, v: x in v, "begins": str.startswith, "ends": str.endswith, "holds": operator.contains}


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str | None]]):
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.policy = options.get("policy", "search")
        self.content = options.get("content", "true") == "true"
        self.globs, self.type = json.loads(options.get("globs", "[]")), options.get("type")
        self.tests: list[tuple[str, object]] = []
        if self.policy not in POLICIES:
            raise ConfigError(f"unknown policy {self.policy!r}")

    def stack(self) -> Stack:
        out = Stack()
        exclude = os.path.join(self.root, PRUNED, "info", "exclude")
        if os.path.isfile(exclude):
            with open(exclude, encoding="utf-8", errors="replace") as f:
                out = Stack(((self.root, Rules(f.read())),))
        return out.entered(self.root)

    def pushFilters(self, filters: list) -> Iterator:
        """Conditions on paths alone are judged before a file is read: equality, membership, and parts of strings; all others go back to Spark."""
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] == "rel" and (test := _TESTS.get(type(f).__name__)):
                self.tests.append((test, f.value))
            else:
                yield f

    def wanted(self, rel: str) -> bool:
        return all(_OPERATIONS[test](rel, value) for test, value in self.tests) and wanted(rel, self.globs, self.type)

    def partitions(self) -> list[InputPartition]:
        """Files listed once, on the driver, and dealt in order by their bytes."""
        if os.path.isfile(self.root):
            return [_Files([(self.root, None)])]
        out, now, size = [], [], 0
        stack = self.stack()
        for top in sorted(os.listdir(self.root)):
            for path, error in walked(self.root, os.path.join(self.root, top), stack, self.policy):
                if not error and not self.wanted(self.rel(path)):
                    continue
                with contextlib.suppress(OSError):
                    size += FILE_BYTES + (os.stat(path).st_size if self.content else 0)
                now.append((path, error))
                if size >= PART_BYTES:
                    out.append(_Files(now))
                    now, size = [], 0
        return [*out, _Files(now)]

    def rel(self, path: str) -> str:
        return os.path.basename(path) if path == self.root else os.path.relpath(path, self.root).replace(os.sep, "/")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, error in partition.files:
            rel = self.rel(path)
            if error:
                yield path, rel, None, None, None, error
                continue
            try:
                if self.content:
                    data, at = sealed(path)
                else:
                    data, at = None, os.stat(path)
            except (OSError, FileChanged) as e:
                yield path, rel, None, None, None, f"unreadable: {getattr(e, 'strerror', None) or e}"
                continue
            if self.policy != "report" or at.st_size <= REPORT_BYTES:
                yield path, rel, at.st_mtime_ns, at.st_size, data, None


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def tree_files(spark: SparkSession, root: str, policy: str = "search", content: bool = True, globs: str | list[str] | None = None, type: str | None = None) -> DataFrame:
    """Files of a folder; those that globs or a type leave out aren't opened."""
    if type and type not in TYPES:
        raise ConfigError(f"unknown file type {type!r}")
    glob_filter(F.col("rel"), globs)  # raises where a glob is wrong
    if not os.path.exists(root):
        raise ConfigError(f"no such path: {root}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # without it Spark refuses readers that take filters
    spark.dataSource.register(TreeSource)
    return spark.read.format("corpus_tree").option("path", root).option("policy", policy).option("content", str(content).lower()).option("globs", json.dumps(as_list(globs))).options(**({"type": type} if type else {})).load()


def tree_corpus(spark: SparkSession, root: str, policy: str = "search", encoding: str | None = None, fallback: str | None = None, globs: str | list[str] | None = None, type: str | None = None) -> Corpus:
    """Texts of a folder or file. Binary files are left out without a word; what can't be decoded or reached is a skip.

    An encoding goes with a file, a fallback with a folder.
    """
    single = os.path.isfile(root)
    if encoding and not single:
        raise ConfigError("an encoding needs a file")
    if fallback and single:
        raise ConfigError("a fallback encoding needs a folder")
    return corpus_of(tree_files(spark, root, policy, True, globs, type), encoding, fallback)


def corpus_of(rows: DataFrame, encoding: str | None = None, fallback: str | None = None) -> Corpus:
    """Texts of files that were read (path, rel, mtime_ns, size, content, error)."""
    # one table of all that was read, which may be kept while a page is made
    good = decode_files(rows.where("error is null").drop("error"), encoding, fallback)
    lost = rows.where("error is not null").select("path", "rel", "mtime_ns", "size", F.lit("lost").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("encoding"), F.col("error").alias("reason"))
    every = good.unionByName(lost, allowMissingColumns=True)
    good, lost = every, every.where("kind = 'lost'").withColumnRenamed("reason", "error")
    files = good.where("kind = 'text'").select("rel", "mtime_ns", "size", "text")
    bad = good.where("kind = 'rejected'").select(F.col("rel").alias("path"), F.concat_ws(": ", "reason", F.array_join("candidates", ", ")).alias("reason"), F.lit("encoding").alias("kind"))
    lost = lost.select(F.col("rel").alias("path"), F.col("error").alias("reason"), F.when(F.startswith("error", F.lit("unreachable")), "unreachable").otherwise("file").alias("kind"))
    other = good.where("kind = 'text' and (encoding <> 'utf-8' or note is not null)").select("rel", "encoding", "rescued", "note")
    return Corpus(files, lost.unionByName(bad), other, (rows, every))


__all__ = ["NAMES", "TreeSource", "tree_corpus", "tree_files"]
