"""Files of tables by Hadoop's file systems, so that any location Spark reads will do."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """(file system, path) of a location."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = at(spark, path)
    return bool(fs.exists(p))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if there is no such folder."""
    fs, p = at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = at(spark, path)
    return bool(fs.delete(p, True))


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, p = at(spark, old)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"can't move {old}")


def size(spark: SparkSession, path: str) -> int:
    fs, p = at(spark, path)
    return fs.getContentSummary(p).getLength()


def put_json(spark: SparkSession, path: str, value) -> None:
    """Written beside and moved into place, so that a reader sees all of it or none."""
    fs, p = at(spark, path + ".new")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    move(spark, path + ".new", path)


def get_json(spark: SparkSession, path: str):
    fs, p = at(spark, path)
    into = fs.open(p)
    try:
        return json.loads(bytes(into.readAllBytes()).decode())
    finally:
        into.close()
