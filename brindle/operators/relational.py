"""Operators that Spark SQL supplies, where they need more than one call: as-of, range and interval joins, guarded broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, *, by: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the latest ``value`` of the same key at or before its time; one shuffle by key, no pairs.

    Both sides are laid together in time order (right rows first at equal times) and
    the last value is carried on. Rows without an earlier value get NULL.
    """
    names = left.columns
    a = left.select(F.struct(*names).alias("__row"), F.col(by).alias("__k"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"))
    b = right.select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(by).alias("__k"), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("__got", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select("__row.*", F.col("__got").alias(value))


def range_join(points: DataFrame, ranges: DataFrame, *, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points in ranges [low, high]: both sides by buckets of ``width``, a range in every bucket it touches."""
    p = points.withColumn("__b", F.floor(F.col(point) / width))
    r = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "__b").where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__b")


def interval_join(a: DataFrame, b: DataFrame, *, low: str, high: str, b_low: str, b_high: str, width: float) -> DataFrame:
    """Pairs of closed intervals that overlap, each once, without a nested loop.

    Both sides lie in every bucket of ``width`` they touch; a pair counts in the bucket
    where the later of the two begins. Choose the width near the usual length: shorter ones
    repeat long intervals, longer ones fill the buckets. Null or reversed ends match nothing.
    """
    spread = lambda df, x, y: df.where(F.col(x) <= F.col(y)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(x) / width), F.floor(F.col(y) / width))))
    met = spread(a, low, high).join(spread(b, b_low, b_high), "__b")
    first = F.floor(F.greatest(F.col(low), F.col(b_low)) / width)
    return met.where((F.col(low) <= F.col(b_high)) & (F.col(b_low) <= F.col(high)) & (F.col("__b") == first)).drop("__b")


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows, which a limited count tells; unmarked beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def theta_join(a: DataFrame, b: DataFrame, condition, rows: int = 100_000) -> DataFrame:
    """Inner join on any condition. ``b`` must be small, as each of its rows meets each of ``a``: a larger one is refused rather than paired with all."""
    if b.limit(rows + 1).count() > rows:
        raise ValueError(f"the right side has over {rows} rows; use an equality, a range or an interval join")
    return a.join(F.broadcast(b), condition)
