"""Jobs on tables: columns added, dropped, altered; files merged; realtime rows moved to history."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rql import expression, plain_numbers
from ..schema import AggSpec, ColumnSpec, TableSpec, parse_text
from ..sources import files, storage
from .rollup import FIRST_SEQ, LAST_SEQ, rollup


def computed(df: DataFrame, spec: ColumnSpec, value: str) -> Column:
    """A column of the given type from an expression of the query dialect; dates and times are parsed from text."""
    sql = expression(value, plain_numbers(df))
    if spec.type in ("DATE", "TIME", "DATETIME"):
        return parse_text(F.expr(sql).cast("string"), spec.type).cast(spec.spark_type)
    return F.expr(sql).cast(spec.spark_type)


def add_columns(df: DataFrame, new: list[tuple[ColumnSpec, str]]) -> DataFrame:
    """Names that exist already are left as they are."""
    have = {c.lower() for c in df.columns}
    add = [(c, v) for c, v in new if c.name.lower() not in have]
    return df.withColumns({c.name: computed(df, c, v) for c, v in add}) if add else df


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Unknown names don't matter."""
    gone = {n.lower() for n in names}
    return df.select(*[c for c in df.columns if c.lower() not in gone])


def alter_columns(df: DataFrame, new: list[tuple[ColumnSpec, str]]) -> DataFrame:
    """New type and value; unknown names don't matter."""
    have = {c.lower(): c for c in df.columns}
    return df.withColumns({have[c.name.lower()]: computed(df, c, v) for c, v in new if c.name.lower() in have})


def partitions(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Names of the partition columns of a dataset, from its folders."""
    out: list[str] = []
    while folders := [x for x in files.children(spark, path) if "=" in x and x[0] not in "_."]:
        out.append(folders[0].split("=", 1)[0])
        path = f"{path}/{folders[0]}"
    return tuple(out)


def dataset(spark: SparkSession, path: str, parts: tuple[str, ...]) -> DataFrame:
    """A dataset with its partition columns as text, as the folders have them."""
    df = spark.read.parquet(path)
    if not parts:
        return df
    schema = T.StructType([f for f in df.schema if f.name not in parts])
    for p in parts:
        schema = schema.add(p, "string")
    return spark.read.schema(schema).parquet(path)


def rewrite(spark: SparkSession, path: str, change, write=None) -> None:
    """Replace a dataset by ``change`` of it, its partition columns kept: written beside it first, the old kept until the new is in place.

    write(df, path, partition columns): how it is written, plainly by default. Between the
    two moves there is a moment without the folder; readers that hit it fail and may retry.
    """
    token, parts = uuid.uuid4().hex, partitions(spark, path)
    new, old = f"{path.rstrip('/')}.new-{token}", f"{path.rstrip('/')}.old-{token}"
    out = change(dataset(spark, path, parts))
    if write:
        write(out, new, parts)
    else:
        out.write.partitionBy(*parts).parquet(new) if parts else out.write.parquet(new)
    files.move(spark, path, old)
    try:
        files.move(spark, new, path)
    except OSError:
        files.move(spark, old, path)
        raise
    files.delete(spark, old)
    spark.catalog.refreshByPath(path)


def compact(spark: SparkSession, path: str, spec: TableSpec, *, bytes_per_file: int = 1 << 31) -> None:
    """Merge small files within each partition folder: rolled up by the dims with grouping, else sorted by them. Answers of aggregates stay.

    Files are dealt out by ranges of the dims, so that they don't overlap, with the
    table's storage mode and indexes.
    """
    n = max(1, -(-files.size(spark, path) // bytes_per_file))

    def merged(df: DataFrame) -> DataFrame:
        parts = [c for c in df.columns if c not in {x.name for x in spec.columns} and c not in (FIRST_SEQ, LAST_SEQ)]
        dims = [*parts, *[d for d in spec.agg.dims if d not in parts]]
        if spec.agg.grouping:
            df = rollup(df, AggSpec(True, dims, spec.agg.metrics), keep_seq=FIRST_SEQ in df.columns)
        if dims:
            return df.repartitionByRange(n, *dims).sortWithinPartitions(*dims)
        return df.repartition(n)

    rewrite(spark, path, merged, lambda df, new, parts: storage.writer(df, spec, parts).parquet(new))


def to_history(rt: DataFrame, spec: TableSpec, path: str, partition: str, value: Column, *, select: dict[str, Column] | None = None, where: Column | None = None, seq=None) -> None:
    """Rows into history partitions by an expression, rolled up in each; only partitions with rows are added to. select: columns computed on the way; where: rows that go over."""
    keyed = (rt if where is None else rt.where(where)).withColumn(partition, value).withColumns(select or {})
    storage.write(keyed.select(*[c.name for c in spec.columns], *[c for c in keyed.columns if c.startswith("_seq_")], partition), path, spec, mode="append", partition_by=(partition,), seq=seq)


def hive_ddl(name: str, spec: TableSpec, location: str, partition: tuple[str, str] | None = None) -> str:
    """CREATE TABLE statement for a table's files."""
    cols = [f"`{c.name}` {c.spark_type.simpleString()}" for c in spec.columns] + ([f"`{partition[0]}` {partition[1]}"] if partition else [])
    part = f" PARTITIONED BY (`{partition[0]}`)" if partition else ""
    props = {"mode": spec.mode, "index.columns": ",".join(c.name for c in spec.columns if c.index), "agg.grouping": str(spec.agg.grouping).lower(), "agg.dims": ",".join(spec.agg.dims), "agg.metrics": ",".join(f"{m.name}:{m.agg}" for m in spec.agg.metrics)}
    return f"CREATE TABLE IF NOT EXISTS `{name}` ({', '.join(cols)}) USING parquet{part} LOCATION '{location}' TBLPROPERTIES ({', '.join(f"'{k}'='{v}'" for k, v in props.items())})"
