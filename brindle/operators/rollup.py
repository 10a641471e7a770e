"""Pre-aggregation of rows with equal dims: sum, min, max, first, last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AggSpec

#: Columns that keep the arrival order of first and last, so that rollups can be rolled up again.
FIRST_SEQ, LAST_SEQ = "_seq_first", "_seq_last"


def rollup(df: DataFrame, agg: AggSpec, *, seq: Column | None = None, keep_seq: bool = False) -> DataFrame:
    """One row for each combination of dims. Metrics keep their column type; sums wrap in it.

    ``seq`` orders arrivals for first and last; a rollup made with ``keep_seq`` has its
    own order and needs none. Rolling up a rollup gives the rollup of the whole.
    """
    kinds = dict(df.dtypes)
    has = FIRST_SEQ in df.columns
    if any(m.agg in ("first", "last") for m in agg.metrics) and seq is None and not has:
        raise ValueError("first and last need an order of arrival")
    low = F.col(FIRST_SEQ) if has else seq if seq is not None else F.lit(0)
    high = F.col(LAST_SEQ) if has else low
    out = []
    for m in agg.metrics:
        c, kind = F.col(m.name), kinds[m.name]
        if m.agg == "sum":
            e = F.sum(c.cast("decimal(38,0)") if kind == "bigint" else c)
            if kind == "int":
                e = ((e.bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)).cast("int")
            elif kind == "bigint":
                two = F.lit(str(1 << 64)).cast("decimal(38,0)")
                e = F.pmod(e, two)
                e = F.when(e >= F.lit(str(1 << 63)).cast("decimal(38,0)"), e - two).otherwise(e).cast("bigint")
            else:
                e = e.cast(kind)
        elif m.agg in ("min", "max"):
            e = getattr(F, m.agg)(c)
        else:
            e = F.min_by(c, low) if m.agg == "first" else F.max_by(c, high)
        out.append(e.alias(m.name))
    if keep_seq:
        out += [F.min(low).alias(FIRST_SEQ), F.max(high).alias(LAST_SEQ)]
    if not out:
        return df.select(*agg.dims).distinct()
    got = df.groupBy(*agg.dims).agg(*out)
    order = [c for c in df.columns if c in got.columns] + ([c for c in (FIRST_SEQ, LAST_SEQ) if keep_seq and c not in df.columns])
    return got.select(*order)
