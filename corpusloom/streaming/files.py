"""A folder as a stream: files come again whenever they have changed."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from corpusloom.errors import FileChanged
from corpusloom.functions.decode import decode_files
from corpusloom.sources.tree import FILE_BYTES, PART_BYTES, SCHEMA, TreeReader, sealed, walked

BEFORE = {"mtime_ns": -1, "rel": ""}


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class TreeStream(DataSourceStreamReader):
    """Offsets are (mtime_ns, rel) of the last file: a batch has the files behind one and up to another."""

    def __init__(self, options: dict):
        self.tree = TreeReader(options)

    def _files(self) -> Iterator[tuple[int, str, str, int]]:
        """(mtime_ns, rel, path, size) of all files now."""
        stack = self.tree.stack()
        for top in sorted(os.listdir(self.tree.root)):
            for path, error in walked(self.tree.root, os.path.join(self.tree.root, top), stack, self.tree.policy):
                rel = self.tree.rel(path)
                if error or not self.tree.wanted(rel):
                    continue
                try:
                    at = os.stat(path)
                except OSError:
                    continue
                yield at.st_mtime_ns, rel, path, at.st_size

    def initialOffset(self) -> dict:
        return BEFORE

    def latestOffset(self) -> dict:
        last = max(((m, rel) for m, rel, _, _ in self._files()), default=None)
        return BEFORE if last is None else {"mtime_ns": last[0], "rel": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        key = lambda o: (o["mtime_ns"], o["rel"])
        out, now, size = [], [], 0
        for mtime, rel, path, n in self._files():
            if key(start) < (mtime, rel) <= key(end):
                now.append((path, rel))
                size += FILE_BYTES + n
                if size >= PART_BYTES:
                    out.append(_Part(now))
                    now, size = [], 0
        return [*out, _Part(now)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, rel in partition.files:
            try:
                data, at = sealed(path)
            except (OSError, FileChanged) as e:
                yield path, rel, None, None, None, f"unreadable: {getattr(e, 'strerror', None) or e}"
                continue
            yield path, rel, at.st_mtime_ns, at.st_size, data, None

    def commit(self, end: dict) -> None:
        pass


class TreeStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_tree_stream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStream(self.options)


def tree_stream(spark: SparkSession, root: str, policy: str = "search") -> DataFrame:
    """Files of a folder (path, rel, mtime_ns, size, content, error) as a stream: all there are, then each that is new or has changed.

    Changes are told by the time of the last one, so a file that is put there
    with an older time than the last file read isn't noticed, and removals aren't
    either. A file that changes again before it is read comes once more in the
    next batch. Names are listed on the driver for each batch, bytes are read by
    tasks.
    """
    spark.dataSource.register(TreeStreamSource)
    return spark.readStream.format("corpus_tree_stream").option("path", root).option("policy", policy).load()


def decoded_stream(files: DataFrame) -> DataFrame:
    """rel, mtime_ns, text of a stream's files that are text."""
    return decode_files(files.where("error is null").drop("error", "path")).where(F.col("kind") == "text").select("rel", "mtime_ns", "text")
