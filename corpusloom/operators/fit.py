"""What fits a budget, for every file of a corpus at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.lines import read_lines
from corpusloom.functions.tokens import TokenCounter, line_totals
from corpusloom.operators.scan import running
from corpusloom.sources.corpus import Corpus

#: Lines of a file that are one block; only the block in which a budget ends is looked at line by line.
BLOCK = 1024
#: Lines that are one batch of results.
BATCH = 1 << 14


def token_lines(corpus: Corpus, counter: TokenCounter) -> DataFrame:
    """rel, line_no, tokens of each line: the exact cost of the file up to and with that line, as if it were counted whole.

    Pretokens are settled as lines go by, and each different one is counted once
    in a task and then looked up, so nothing is shuffled. A null text has no
    lines; an empty corpus gives no rows. The counter, a vocabulary, is sent to the
    tasks.
    """
    sent = corpus.files.sparkSession.sparkContext.broadcast(counter)  # a vocabulary, whatever the corpus

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sent.value
        rels, numbers, totals = [], [], []

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(rels, pa.string()), pa.array(numbers, pa.int64()), pa.array(totals, pa.int64())], ["rel", "line_no", "tokens"])
            rels.clear(), numbers.clear(), totals.clear()
            return out

        for batch in batches:
            for rel, text in zip(batch.column("rel").to_pylist(), batch.column("text")):
                for no, total in enumerate(line_totals(text.as_py() or "", count), 1):
                    rels.append(rel), numbers.append(no), totals.append(total)
                    if len(rels) == BATCH:
                        yield made()
        if rels:
            yield made()

    return corpus.files.select("rel", "text").mapInArrow(f, "rel string, line_no long, tokens long")


def token_budget(corpus: Corpus, counter: TokenCounter, budget: int) -> DataFrame:
    """rel, last_line, lines of each file that has lines: the last line before the first that exceeds the budget (0: not even one fits), and how many there are."""
    over = F.min(F.when(F.col("tokens") > budget, F.col("line_no")))
    lines = F.max("line_no")
    return token_lines(corpus, counter).groupBy("rel").agg((F.coalesce(over, lines + 1) - 1).alias("last_line"), lines.alias("lines"))


def budget_prefix(lines: DataFrame, by: str, order: str, cost: str, budget: int) -> DataFrame:
    """by, last, spent of each key of lines (by, order, cost): the last row, in order, with which the sum of costs stays within the budget, and that sum; last is null where not even the first row fits.

    order numbers the rows of a key, without gaps or with some; costs are whole
    numbers of 0 or more, null is 0. Rows are summed by blocks of BLOCK numbers
    first; running totals of blocks, dealt over tasks for a key of any size, tell
    the one block in which the budget ends; only its rows are looked at one by
    one. Rows without an order are none; a null key is a key; an empty table gives
    no rows. Rows with one number count in some order, all of one block together.
    """
    rows = lines.where(F.col(order).isNotNull()).select(F.col(by).alias("_by"), F.col(order).cast("long").alias("_no"), F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("_cost"))
    rows = rows.withColumn("_part", F.floor(F.col("_no") / BLOCK))
    blocks = rows.groupBy("_by", "_part").agg(F.sum("_cost").alias("_sum"), F.max("_no").alias("_last"))
    totals = running(blocks, ["_by"], ["_part"], {"_total": "_sum"})
    # of each key: what its whole blocks within the budget come to, and the block behind them
    ends = totals.groupBy("_by").agg(
        F.max(F.when(F.col("_total") <= budget, F.struct("_part", "_last", "_total"))).alias("_whole"),
        F.min(F.when(F.col("_total") > budget, F.struct("_part", (F.col("_total") - F.col("_sum")).alias("_before")))).alias("_cut"),
    )
    cut = ends.where("_cut is not null").select(F.col("_by").alias("_key"), F.col("_cut._part").alias("_cut_part"), F.col("_cut._before").alias("_before"))
    # a key's rows in one block are few
    inside = rows.join(cut, F.col("_by").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_cut_part")))
    w = Window.partitionBy("_by", "_part").orderBy("_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_so_far", F.col("_before") + F.sum("_cost").over(w))
    inside = inside.where(F.col("_so_far") <= budget).groupBy("_by").agg(F.max(F.struct("_no", "_so_far")).alias("_inside")).withColumnRenamed("_by", "_key")
    out = ends.join(inside, F.col("_by").eqNullSafe(F.col("_key")), "left")
    return out.select(F.col("_by").alias(by), F.coalesce("_inside._no", "_whole._last").alias("last"), F.coalesce("_inside._so_far", "_whole._total", F.lit(0)).cast("long").alias("spent"))


def file_lines(corpus: Corpus, cost=lambda line: F.octet_length(line) + 1) -> DataFrame:
    """rel, line_no, cost of each line of a corpus, by default its bytes and one for its end; texts themselves aren't shuffled."""
    lines = F.transform(read_lines(F.col("text")), cost)
    return corpus.files.select("rel", F.posexplode(lines).alias("k", "cost")).select("rel", (F.col("k") + 1).cast("long").alias("line_no"), F.col("cost").cast("long").alias("cost"))
