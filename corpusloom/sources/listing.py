"""Folders listed on executors, level by level, and files read from such a listing.

The driver holds no names: each level is a table of folders with the ignore rules
that hold in them, tasks list these and hand on the folders below. A level is a
job, so there are as many jobs as the tree is deep.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.errors import ConfigError, FileChanged
from corpusloom.functions.globs import TYPES, glob_filter, type_filter
from corpusloom.sources.ignore import NAMES, Rules, Stack
from corpusloom.sources.scratch import stored
from corpusloom.sources.tree import POLICIES, PRUNED, REPORT_BYTES, sealed

#: Folders that one task lists, and bytes of files that one task reads, about.
FOLDERS, PART_BYTES, FILE_BYTES = 256, 32 << 20, 4 << 10
FOUND = "kind string, path string, rel string, mtime_ns long, size long, error string, rules array<struct<folder:string,text:string>>"
LISTED = "path string, rel string, mtime_ns long, size long, error string"
_COLUMNS = [x.split()[0] for x in "kind,path,rel,mtime_ns,size,error,rules".split(",")]


def _text(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return None


def entered(folder: str, rules: list[dict]) -> list[dict]:
    """The rules that hold in a folder, those of its own ignore files last."""
    own = [{"folder": folder, "text": t} for name in NAMES if (t := _text(os.path.join(folder, name))) is not None]
    return [*rules, *own]


def entries(folder: str, root: str, rules: list[dict], policy: str) -> Iterator[tuple]:
    """FOUND of what a folder holds itself; links to files count, links to folders and broken ones don't."""
    rel = lambda path: os.path.relpath(path, root).replace(os.sep, "/")
    stack = Stack(tuple((r["folder"], Rules(r["text"])) for r in rules)) if policy != "all" else Stack()
    try:
        names = os.scandir(folder)
    except OSError as e:
        yield "file", folder, rel(folder), None, None, f"unreachable: {e.strerror}", None
        return
    with names:
        for x in names:
            if policy == "report" and x.name.startswith("."):
                continue
            folder_here = x.is_dir(follow_symlinks=False)
            if not folder_here and x.is_symlink() and not os.path.isfile(x.path):
                continue
            if folder_here and x.name == PRUNED or policy != "all" and stack.ignored(x.path, folder_here):
                continue
            if folder_here:
                yield "folder", x.path, None, None, None, None, rules
                continue
            try:
                at = os.stat(x.path)
            except OSError as e:
                yield "file", x.path, rel(x.path), None, None, f"unreadable: {e.strerror}", None
                continue
            if policy != "report" or at.st_size <= REPORT_BYTES:
                yield "file", x.path, rel(x.path), at.st_mtime_ns, at.st_size, None, None


def _listing(root: str, policy: str, batch: int = 4096):
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for frame in frames:
            for folder, rules in zip(frame["path"], frame["rules"]):
                held = [{"folder": r["folder"], "text": r["text"]} for r in (rules if rules is not None else [])]
                for row in entries(folder, root, entered(folder, held) if policy != "all" else [], policy):
                    rows.append(row)
                    if len(rows) == batch:  # a folder of any size
                        yield pd.DataFrame(rows, columns=_COLUMNS).astype({"mtime_ns": "Int64", "size": "Int64"})
                        rows = []
        yield pd.DataFrame(rows, columns=_COLUMNS).astype({"mtime_ns": "Int64", "size": "Int64"})

    return f


def listed(spark: SparkSession, root: str, policy: str = "search", globs: str | list[str] | None = None, type: str | None = None) -> DataFrame:
    """LISTED of the files of a folder that globs and a type keep, with an error where a name can't be reached.

    Files and folders are those of the data source `corpus_tree`. One folder is
    listed by one task, of any number of names. All executors must see the folder.
    """
    if policy not in POLICIES:
        raise ConfigError(f"unknown policy {policy!r}")
    if type and type not in TYPES:
        raise ConfigError(f"unknown file type {type!r}")
    root = os.path.abspath(root)
    exclude = _text(os.path.join(root, PRUNED, "info", "exclude")) if policy != "all" else None
    first = [(root, [{"folder": root, "text": exclude}] if exclude is not None else [])]
    now = spark.createDataFrame(first, "path string, rules array<struct<folder:string,text:string>>")
    keep = [c for c in (glob_filter(F.col("rel"), globs), type_filter(F.col("rel"), type) if type else None) if c is not None]
    files, n = None, 1
    while n:
        level = stored(now.repartition(max(1, min(-(-n // FOLDERS), spark.sparkContext.defaultParallelism * 8))).mapInPandas(_listing(root, policy), FOUND))
        found = level.where("kind = 'file'").select("path", "rel", "mtime_ns", "size", "error")
        files = found if files is None else files.unionByName(found)
        now = level.where("kind = 'folder'").select("path", "rules")
        n = now.count()
    for c in keep:
        files = files.where(F.col("error").isNotNull() | c)
    return files


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            data, mtime, size, error = None, r["mtime_ns"], r["size"], r["error"]
            if not error:
                try:
                    data, at = sealed(r["path"])
                    mtime, size = at.st_mtime_ns, at.st_size
                except (OSError, FileChanged) as e:
                    mtime, size, error = None, None, f"unreadable: {getattr(e, 'strerror', None) or e}"
            # a file is a batch, so that one task holds one
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((r["path"], pa.string()), (r["rel"], pa.string()), (mtime, pa.int64()), (size, pa.int64()), (data, pa.binary()), (error, pa.string()))], ["path", "rel", "mtime_ns", "size", "content", "error"])


def contents(listing: DataFrame) -> DataFrame:
    """Files of a listing with their bytes, dealt to tasks by size; what was changed or lost since is an error."""
    total = listing.agg(F.sum(F.coalesce("size", F.lit(0)) + FILE_BYTES)).first()[0] or 0
    tasks = max(1, -(-int(total) // PART_BYTES))
    return listing.repartition(tasks, "path").mapInArrow(_read, "path string, rel string, mtime_ns long, size long, content binary, error string")


def newest(listing: DataFrame, n: int) -> DataFrame:
    """The n files of a listing that changed last, all that are as old as the last of them, and those with an error."""
    edge = listing.where("error is null").select("mtime_ns").orderBy(F.desc("mtime_ns")).limit(n).agg(F.min("mtime_ns").alias("m")).first().m
    return listing.where(F.col("error").isNotNull() | (F.col("mtime_ns") >= F.lit(edge if edge is not None else 0)))
