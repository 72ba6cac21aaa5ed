"""A corpus: one row per file, with rel, mtime_ns, size and text."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Corpus:
    """files: rel STRING, mtime_ns LONG, size LONG, text STRING; skips: path, reason, kind of what couldn't be read; encodings: rel, encoding, rescued, note of what wasn't UTF-8."""

    files: DataFrame
    skips: DataFrame | None = None
    encodings: DataFrame | None = None
    #: What files, skips and encodings are taken from, that is read first.
    sources: tuple[DataFrame, ...] = ()

    def notes(self) -> list[str]:
        """What was decoded from other encodings, each once, in order."""
        if self.encodings is None:
            return []
        rows = self.encodings.agg(F.array_sort(F.collect_set("encoding")).alias("e"), F.count_if("rescued").alias("n"), F.array_sort(F.collect_set("note")).alias("notes")).first()
        return [f"Decoded from {e}." for e in rows.e] + ([f"{rows.n} by the fallback encoding."] if rows.n else []) + list(rows.notes)

    @contextlib.contextmanager
    def held(self) -> Iterator[Corpus]:
        """The corpus read and decoded once, while it is used: what all its tables come from is kept on the executors' disks."""
        kept = [x.persist(StorageLevel.DISK_ONLY) for x in self.sources]
        try:
            yield self
        finally:
            for x in kept:
                x.unpersist()


def table_corpus(df: DataFrame, rel: Column, newer: Column, text: str) -> Corpus:
    """Rows of a table as files: a path expression, one that grows with recency, and the text column; null text is empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return Corpus(df.select(rel.alias("rel"), newer.cast("long").alias("mtime_ns"), F.octet_length(body).cast("long").alias("size"), body.alias("text")))


def documents_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Table documents as files source/lang/id.txt; larger ids are newer."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rel = F.concat_ws("/", "source", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")))
    return table_corpus(docs, rel, F.col("doc_id"), "text")
