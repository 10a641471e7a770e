"""Shared pieces: scratch tables, hashing, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MIX = U64(0x9E3779B97F4A7C15)
#: Spark's setting by which the shuffle files of a finished query are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key with more than one in so many rows is joined by broadcast; there are fewer such keys than this.
HOT = 512
#: What this process remembers between tasks, by the operator that owns it.
REMEMBERED: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder under /tmp and any other
    session a folder inside its warehouse, which executors can reach as well.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return "file:///tmp/brindle-scratch"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/brindle-scratch"


class Scratch:
    """Intermediate tables in the shared folder.

    Written tables cut the lineage and survive the loss of executors.
    ``drop`` frees one early; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self._keep = []

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def store(self, df: DataFrame, name: str, unlike: tuple[str, ...] = ()) -> DataFrame:
        """unlike: columns of which few values are equal, so that no dictionary is tried."""
        path = f"{self.root}/{name}"
        with shuffles_removed(self.spark):
            df.write.mode("overwrite").options(compression="zstd", **{f"parquet.enable.dictionary#{c}": "false" for c in unlike}).parquet(path)
        fs, at = self._fs(path)
        fs.deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                fs, at = self._fs(path)
                fs.delete(at, True)

    def drop_named(self, *names: str) -> None:
        """Free the tables stored under these names, which no later plan may read."""
        for t in [t for t in self._keep if self.paths.get(id(t), "").rsplit("/", 1)[-1] in names]:
            self.drop(t)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that run within lose their shuffle files when they end, not when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def hot_join(scratch: Scratch, many: DataFrame, one: DataFrame, on: list[str], n: str, name: str) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one row a key and in ``n`` the number of its rows in ``many``.

    Keys with more than a 512th of all rows, so fewer than 512 keys, are broadcast; the
    others are shuffled, none of which is large. ``many`` should be a stored table, as it
    is read twice where there are hot keys.
    """
    one = scratch.store(one, name)
    total, most = one.agg(F.sum(n), F.max(n)).first()
    if (most or 0) * HOT <= (total or 0):
        return many.join(one, on)
    is_hot = F.col(n) * HOT > F.lit(total)
    hot = one.where(is_hot)
    cold = many.join(F.broadcast(hot.select(*on)), on, "left_anti").join(one.where(~is_hot), on)
    return many.join(F.broadcast(hot), on).unionByName(cold)


def remember(owner: str) -> dict:
    """What this worker keeps for ``owner`` from task to task. What other operators kept is forgotten, so a reused worker holds one operator's tables."""
    others = [k for k in REMEMBERED if k != owner]
    if others:
        for k in others:
            del REMEMBERED[k]
        trim()
    return REMEMBERED.setdefault(owner, {})


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches, rows: int = 512):
    """Arrow batches cut into short ones, so that what is built per batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def sorted_set(x: np.ndarray) -> np.ndarray:
    """The different words in order; for short arrays much faster than numpy's own way."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def runs_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbouring words; by doubling, so in log(width) passes."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    done, level, size, have = None, values.astype(U64), 1, 0
    while True:
        if width & size:
            part = level[have : have + n]
            done = part.copy() if done is None else mix64(done * MIX + part)
            have += size
        if size * 2 > width:
            return mix64(done)
        level = level[:-size] * U64(0xD6E8FEB86659FD93) + (level[size:] ^ (level[size:] >> U64(29)))
        size *= 2


def components(scratch: Scratch, edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node.

    Distributed union-find by alternating large-star and small-star rounds. Each
    partition first unites its own edges, so that long chains are short before
    anything is shuffled. A round reads minima by aggregation and joins them
    back, those of nodes with very many neighbours by broadcast; no node's
    neighbours are ever gathered. Any orderable id type works.
    Nodes without an edge to another node aren't returned.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def local(batches):
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def flush():
            a = [x for x in parent if find(x) != x]
            out = pa.table({"a": a, "b": [find(x) for x in a]}) if a else None
            parent.clear()
            return out

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parent.setdefault(x, x)
                parent.setdefault(y, y)
                rx, ry = find(x), find(y)
                if rx != ry:
                    parent[max(rx, ry)] = min(rx, ry)
            if len(parent) > 200_000 and (t := flush()) is not None:
                yield from t.to_batches()
        if (t := flush()) is not None:
            yield from t.to_batches()

    now = edges.select("a", "b").where(F.col("a") != F.col("b"))
    now = scratch.store(now.mapInArrow(local, f"a {kind}, b {kind}"), f"{name}-0")
    same, before = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))), None
    for k in range(1, most_rounds):
        # large star: what is above u goes to the least of u and its neighbours
        both = now.select(F.col("a").alias("u"), "b").unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("b")))
        least = both.groupBy("u").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = hot_join(scratch, both, least, ["u"], "n", f"{name}-least-{k}").where(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: what is below u, and u, go to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
        low = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        j = down.join(low, down.a == low.u)
        small = j.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        new = scratch.store(small, f"{name}-{k}")
        after = new.agg(same).first()[0]
        done, before = after == before, after
        scratch.drop(now)
        scratch.drop_named(f"{name}-least-{k}")
        now = new
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")
