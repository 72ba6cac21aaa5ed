"""Windows of lines of files, one or many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.errors import ConfigError
from corpusloom.functions.lines import read_lines, truncated
from corpusloom.sources.corpus import Corpus

MOST_ENTRIES = 32
#: Texts above so many bytes have no exact number of lines.
COUNTED = 64 << 20
REQUEST = "ord int, path string, offset long, limit long"


def requests(spark: SparkSession, entries: list[dict], limit: int | None = None) -> DataFrame:
    """ord, path, offset, limit of the entries; a limit for all fills those without one. Repeated entries are an error."""
    if not 1 <= len(entries) <= MOST_ENTRIES:
        raise ConfigError(f"a read takes 1 to {MOST_ENTRIES} files")
    rows = [(k, e["path"], int(e.get("offset") or 1), e.get("limit") or limit) for k, e in enumerate(entries)]
    for _, _, offset, n in rows:
        if offset < 1 or n is not None and n < 1:
            raise ConfigError("offset and limit count from 1")
    if len({r[1:] for r in rows}) < len(rows):
        raise ConfigError("an entry is there twice")
    return spark.createDataFrame(rows, REQUEST)


def repeated_requests(rows: DataFrame) -> DataFrame:
    """path, offset, limit, times of entries that are there more than once."""
    return rows.groupBy("path", "offset", "limit").agg(F.count("*").alias("times")).where("times > 1")


def total_lines(text: Column) -> Column:
    return F.when(F.octet_length(text) <= COUNTED, F.size(read_lines(text)).cast("long"))


def segments(corpus: Corpus, wanted: DataFrame) -> DataFrame:
    """ord, path, error, warning, first_line, last_line, total_lines, lines for each request.

    A missing file is an error in its row, an empty one or a window behind the
    end a warning. Requests are few, so they are broadcast to the files.
    """
    files = corpus.files.select(F.col("rel").alias("path"), read_lines(F.col("text")).alias("all"), total_lines(F.col("text")).alias("total_lines"))
    few = F.broadcast(wanted)  # MOST_ENTRIES rows at most when made by requests()
    hit = files.join(few, "path")
    last = F.least(F.size("all").cast("long"), F.coalesce(F.col("offset") + F.col("limit") - 1, F.lit((1 << 31) - 1).cast("long")))
    hit = hit.withColumn("n", F.greatest(last - F.col("offset") + 1, F.lit(0)))
    lines = F.when(F.col("n") > 0, F.transform(F.slice("all", F.col("offset").cast("int"), F.col("n").cast("int")), lambda x: truncated(x))).otherwise(F.array().cast("array<string>"))
    hit = hit.select("ord", F.col("total_lines"), F.when(F.col("n") > 0, F.col("offset")).alias("first_line"), F.when(F.col("n") > 0, F.col("offset") + F.col("n") - 1).alias("last_line"), lines.alias("lines"))
    out = wanted.join(hit, "ord", "left")
    error = F.when(F.col("lines").isNull(), F.lit("no such file"))
    warning = F.when(F.col("total_lines") == 0, F.lit("the file is empty")).when(F.size("lines") == 0, F.lit("the window begins behind the end"))
    return out.select("ord", "path", error.alias("error"), F.when(F.col("lines").isNotNull(), warning).alias("warning"), "first_line", "last_line", "total_lines", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def window(corpus: Corpus, offset: int = 1, limit: int | None = None) -> DataFrame:
    """rel, line_no, line of a window of each file of a corpus."""
    n = F.lit(limit if limit is not None else (1 << 31) - 1)
    rows = corpus.files.select("rel", F.slice(read_lines(F.col("text")), F.lit(offset), n).alias("lines"))
    rows = rows.select("rel", F.posexplode("lines").alias("k", "line"))
    return rows.select("rel", (F.col("k") + offset).cast("long").alias("line_no"), truncated(F.col("line")).alias("line"))
