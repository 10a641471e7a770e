"""CSV files into tables and out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TableSpec, parse_text


def load(spark: SparkSession, paths: str | list[str], spec: TableSpec, *, header: list[str] | None = None, sep: str = ",") -> DataFrame:
    """Rows of CSV files (wildcards allowed) by a header of column names, the specification's order without one.

    Empty or missing fields become the column's default or zero. Columns that aren't in
    the header are filled likewise, header names that aren't columns are skipped.
    """
    names = header or [c.name for c in spec.columns]
    raw = spark.read.schema(T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])).option("sep", sep).csv(paths)
    at = {n.lower(): f"_{i}" for i, n in enumerate(names)}
    out = []
    for c in spec.columns:
        text = F.col(at[c.name.lower()]) if c.name.lower() in at else F.lit(None).cast("string")
        out.append(F.coalesce(parse_text(F.when(text != "", text), c.type), c.filler()).cast(c.spark_type).alias(c.name))
    return raw.select(*out)


def export(df: DataFrame, path: str, *, columns: tuple[str, ...] = (), sep: str = ",", mode: str = "overwrite") -> None:
    """Chosen columns as CSV without header or quotes."""
    df.select(*(columns or df.columns)).write.mode(mode).option("sep", sep).option("quote", "").option("escape", "").option("emptyValue", "").csv(path)
