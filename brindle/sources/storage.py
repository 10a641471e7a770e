"""Tables as sorted Parquet with statistics, written and read with the engine's options."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Filter
from ..operators.rollup import FIRST_SEQ, rollup
from ..schema import AggSpec, ColumnSpec, TableSpec, mode_name
from . import files

# Parquet options of the storage modes.
MODE_OPTIONS = {"basic": {"compression": "snappy"}, "vlt": {"compression": "zstd"}}
#: Rows of a file at most; Parquet's row groups and pages inside it carry statistics.
FILE_ROWS = 8_000_000
#: Folder of the statistics of a table's files; the underscore hides it from readers.
MANIFEST = "_manifest"


def fill_nulls(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Missing values become the column's default or zero."""
    return df.select(*[F.coalesce(F.col(c), spec.column(c).filler()).alias(c) if c in {s.name for s in spec.columns} else F.col(c) for c in df.columns])


def infer(df: DataFrame) -> TableSpec:
    """A specification of the columns of a DataFrame; types without a counterpart are refused."""
    names = {"int": "INT", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "DATETIME", "timestamp": "DATETIME"}
    if bad := [c for c, k in df.dtypes if k not in names]:
        raise ValueError(f"no column type for {bad}")
    return TableSpec([ColumnSpec(c, names[k]) for c, k in df.dtypes])


def writer(df: DataFrame, spec: TableSpec, partition_by: tuple[str, ...] = (), *, mode: str = "append", file_rows: int = FILE_ROWS) -> DataFrameWriter:
    """A writer with the storage mode's options and bloom filters of the index columns."""
    w = df.write.mode(mode).option("maxRecordsPerFile", file_rows)
    for k, v in MODE_OPTIONS[mode_name(spec.mode)].items():
        w = w.option(k, v)
    for c in spec.columns:
        if c.index:
            w = w.option(f"parquet.bloom.filter.enabled#{c.name}", "true")
    return w.partitionBy(*partition_by) if partition_by else w


def write(df: DataFrame, path: str, spec: TableSpec | None = None, *, mode: str = "append", null_policy: str = "default", partition_by: tuple[str, ...] = (), seq=None, keep_seq: bool = False, file_rows: int = FILE_ROWS, manifest: bool = False) -> None:
    """Write a table. With grouping the rows are rolled up by their dims; with dims files hold ranges of them, sorted.

    null_policy: default (missing values become defaults) or keep. Index columns get
    bloom filters. A failed write leaves no files (Spark's commit protocol). manifest:
    keep the least and greatest values of the dims by file beside the files, for ``read``.
    """
    spec = spec or infer(df.select(*[c for c in df.columns if c not in partition_by]))
    if null_policy == "default":
        df = fill_nulls(df, spec)
    elif null_policy != "keep":
        raise ValueError("null_policy is default or keep")
    agg = spec.agg
    if agg.grouping:
        df = rollup(df, AggSpec(True, [*agg.dims, *[p for p in partition_by if p not in agg.dims]], agg.metrics), seq=seq, keep_seq=keep_seq)
    if agg.dims:
        by = [*partition_by, *[d for d in agg.dims if d not in partition_by]]
        df = df.repartitionByRange(*by).sortWithinPartitions(*by)
    writer(df, spec, partition_by, mode=mode, file_rows=file_rows).parquet(path)
    if manifest:
        record(df.sparkSession, path, spec)


def record(spark: SparkSession, path: str, spec: TableSpec) -> None:
    """Add to the manifest what it lacks: rows, least and greatest values of the dims of each file. Only new files are read, and of them only the dims."""
    have = f"{path}/{MANIFEST}"
    df = spark.read.schema(spec.schema).option("pathGlobFilter", "*.parquet").parquet(path)
    new = df.inputFiles()
    if files.exists(spark, have):
        old = spark.read.parquet(have).select("file")
        names = spark.createDataFrame([(plain(x),) for x in new], "file string")
        new = [r["file"] for r in names.join(old, "file", "left_anti").collect()]
    if new:
        own = spark.read.schema(spec.schema).option("basePath", path).parquet(*new)
        manifest(own, tuple(spec.agg.dims)).coalesce(1).write.mode("append").parquet(have)


def read(spark: SparkSession, path: str, spec: TableSpec | None = None, where: Filter | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """Read a table: columns by name whatever their case, those missing in old files as NULL, the filter pushed down.

    With a specification the schema comes from it and no footer is read to learn it (partition
    columns follow it); without one it is that of all files. Hidden and unfinished files
    (``_``, ``.``, ``*__``) are left out. Where there is a manifest, files that the
    filter's rough check rules out aren't opened; files it doesn't know are.
    """
    r = spark.read.option("pathGlobFilter", "*.parquet")
    r = r.option("mergeSchema", "true") if spec is None else r.schema(spec.schema)
    df = r.parquet(path)
    if where is not None:
        where = where.optimize()
        if spec is not None and files.exists(spark, f"{path}/{MANIFEST}"):
            man = spark.read.parquet(f"{path}/{MANIFEST}")
            known = {c[4:] for c in man.columns if c.startswith("min_")}
            out = {x["file"] for x in man.where(~where.may_hold(known)).select("file").collect()}
            if out:
                keep = [f for f in df.inputFiles() if plain(f) not in out]
                df = r.option("basePath", path).parquet(*keep) if keep else df.where("false")
        df = df.where(where.to_column())
    return df.select(*columns) if columns else df


def plain(file: str) -> str:
    """A file's address as Spark's metadata column has it."""
    return file.replace("file:///", "file:/")


def manifest(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Least and greatest value of some columns by file of a dataset, what a rough check needs."""
    aggs = [f(c).alias(f"{n}_{c.lower()}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *aggs)


def hybrid(rt: DataFrame, hist: DataFrame, group_col: str) -> DataFrame:
    """Fresh and historical rows; a group of files that is in both counts from the fresh side."""
    fresh = rt.select(group_col).distinct()
    old = hist.join(fresh, group_col, "left_anti")
    return rt.unionByName(old, allowMissingColumns=True)


__all__ = ["FIRST_SEQ", "fill_nulls", "hybrid", "infer", "manifest", "read", "record", "write", "writer"]
