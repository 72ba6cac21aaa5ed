"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the least node reachable.

    Alternates large-star and small-star steps until the edges are stars. Each
    step keeps a minimum per node (combined before the shuffle) and joins it
    back, so no neighbourhood is held in one task; hubs are split by adaptive
    skew joins. The edges of a step are a table in the shared folder. Loops and
    repeated edges are allowed; null ends are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new == state or not new["n"]:
            break
        state = new
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        dropped(now)
        now = after
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(now.select("v", "v").toDF("node", "component")).distinct()
