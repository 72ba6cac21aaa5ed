"""Reports on a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.globs import extension
from corpusloom.sources.corpus import Corpus

#: Files of more bytes are left out of reports; extensions that are listed.
MOST_BYTES, LISTED = 1 << 20, 15


def reported(corpus: Corpus) -> DataFrame:
    """Files up to MOST_BYTES without hidden components."""
    return corpus.files.select("rel", "size").where((F.col("size") <= MOST_BYTES) & ~F.col("rel").rlike(r"(^|/)\."))


def by_extension(corpus: Corpus, most: int = LISTED) -> DataFrame:
    """extension, files: the most frequent ones, ties by name; '' stands for none."""
    rows = reported(corpus).groupBy(extension(F.col("rel")).alias("extension")).agg(F.count("*").alias("files"))
    return rows.orderBy(F.desc("files"), "extension").limit(most)


def totals(corpus: Corpus) -> DataFrame:
    """files, bytes: one row."""
    return reported(corpus).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
