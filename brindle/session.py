"""Spark sessions with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "brindle", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and non-ANSI casts (bad values become NULL).

    The number of shuffle partitions is left to the cluster; adaptive execution
    joins small ones and splits skewed ones.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.timeType.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
