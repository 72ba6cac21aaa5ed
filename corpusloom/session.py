"""A session with the settings the engine is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corpusloom", **conf: str) -> SparkSession:
    """Adaptive execution, Arrow, UTC, and path filters pushed into Python sources; conf overrides."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
    } | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
