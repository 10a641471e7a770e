"""Functions of one's own for the dialect and Spark SQL: vectorised, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession, name: str, f: Callable, returns: str, kind: str = "scalar") -> None:
    """Make ``f`` known to the session under ``name``, for queries of either language.

    kind: scalar (pandas Series in, Series out), aggregate (Series in, one value out; the
    type hints of ``f`` tell which), or table (a class with ``eval`` that yields rows,
    used in FROM by Spark SQL).
    """
    if kind in ("scalar", "aggregate"):
        spark.udf.register(name, F.pandas_udf(f, returns))
    elif kind == "table":
        spark.udtf.register(name, F.udtf(f, returnType=returns))
    else:
        raise ValueError("kind is scalar, aggregate or table")
