"""Realtime tables: a streaming query that rolls events up into small groups of files, merged and moved later.

State lives in Spark's checkpoint; each micro-batch writes one folder by its id,
so a replayed batch overwrites itself. Groups go through these states:

* saved: a batch's folder under ``rt``, read by ``hybrid``;
* merging: a history folder that is written but flagged as pending, not read yet;
* merged: one commit file names the history group and the batches it replaces; from
  the moment it is there, readers take the one instead of the others;
* done: the batches are deleted, then the flag and the commit file.

A failure between any two steps leaves a table that reads right; ``settle`` finishes
or undoes what was left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rollup import FIRST_SEQ, LAST_SEQ, rollup
from ..schema import TableSpec
from ..sources import files, storage
from .ingest import IngestSpec, csv_messages, ingest_json, normalise

GROUP = "rt_group"
#: Fetchers by type: a function from the session and the fetcher's settings to a stream with a column value.
FETCHERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def fetcher(*kinds: str):
    """Register a fetcher under these types; plugins may add their own."""

    def add(f):
        for kind in kinds:
            FETCHERS[kind] = f
        return f

    return add


@fetcher("kafka-0.8", "kafka")
def _kafka(spark: SparkSession, how: dict) -> DataFrame:
    p = how.get("properties") or {}
    r = spark.readStream.format("kafka").option("subscribe", ",".join(how.get("topics") or [how["topic"]])).option("kafka.bootstrap.servers", p.get("bootstrap.servers") or p.get("metadata.broker.list", ""))
    r = r.option("startingOffsets", {"largest": "latest", "smallest": "earliest"}.get(p.get("auto.offset.reset", "largest"), "latest"))
    if n := how.get("max.offsets"):
        r = r.option("maxOffsetsPerTrigger", n)
    return r.load().selectExpr("CAST(value AS STRING) AS value")


@fetcher("csv", "json", "text")
def _lines(spark: SparkSession, how: dict) -> DataFrame:
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", how.get("max.files", 1000)).text(how["path"])


@fetcher("test")
def _test(spark: SparkSession, how: dict) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", how.get("rate", 1)).load().selectExpr("to_json(map('value', value)) AS value")


@fetcher("console")
def _console(spark: SparkSession, how: dict) -> DataFrame:
    return spark.readStream.format("socket").option("host", how.get("host", "localhost")).option("port", how["port"]).load()


def source(spark: SparkSession, how: dict) -> DataFrame:
    """A stream of messages by the fetcher's type: kafka-0.8 (or kafka), csv, json or text files, test, console, or a registered one."""
    if how.get("type") not in FETCHERS:
        raise ValueError(f"unknown fetcher {how.get('type')}")
    return FETCHERS[how["type"]](spark, how)


def rows_of(messages: DataFrame, spec: TableSpec, how: IngestSpec, fetch: dict, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows of messages, with the place of a row in its message (_pos): CSV lines by the fetcher's header, else JSON."""
    if fetch.get("type") != "csv":
        return ingest_json(messages, spec, how, keep=keep)
    header = fetch.get("header") or [c.name for c in spec.columns]
    events = csv_messages(messages, header, fetch.get("separator", ","), keep=keep).withColumn("_pos", F.lit(0))
    return normalise(events, spec, how, keep=(*keep, "_pos"))


def start(messages: DataFrame, spec: TableSpec, location: str, checkpoint: str, *, how: IngestSpec | None = None, fetch: dict | None = None, available_now: bool = False, period: str = "20 minutes", name: str | None = None, stats: list | None = None) -> StreamingQuery:
    """Run ingestion into ``location``/rt. Each batch is one group of rolled-up files.

    ``fetch``: the fetcher's settings, which tell how messages are read. ``stats`` gets a
    dictionary a batch: messages consumed, rows produced, and groups of rows after rollup.
    """
    how = how or IngestSpec.of(spec.realtime)
    fetch = fetch or spec.realtime.get("fetcher") or {}
    rt = f"{location}/rt"

    def save(batch: DataFrame, n: int) -> None:
        consumed, produced = Observation(f"consumed-{n}"), Observation(f"produced-{n}")
        messages_in = batch.withColumn("_row", F.monotonically_increasing_id()).observe(consumed, F.count("*").alias("n"))
        rows = rows_of(messages_in, spec, how, fetch, ("_row",)).observe(produced, F.count("*").alias("n"))
        # arrival: batch, then row and object in it; all fits into one growing number
        order = F.lit(n).cast("decimal(38,0)") * F.lit(str(10**24)).cast("decimal(38,0)") + F.col("_row").cast("decimal(38,0)") * F.lit(100_000) + F.col("_pos")
        if spec.agg.grouping:
            rows = rollup(rows, spec.agg, seq=order.cast("decimal(38,0)"), keep_seq=True)
        else:
            rows = rows.select(*[c.name for c in spec.columns])
        if spec.agg.dims:
            rows = rows.sortWithinPartitions(*spec.agg.dims)
        rows.write.mode("overwrite").parquet(f"{rt}/{GROUP}=batch-{n:012d}")
        if stats is not None:
            stats.append({"batch": n, "consumed": consumed.get["n"], "produced": produced.get["n"]})

    w = messages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=period)).start()


def stop(spark: SparkSession, name: str) -> bool:
    """Stop the ingestion of that name; False if none runs here. What it has saved stays, a restart goes on from the checkpoint."""
    found = [q for q in spark.streams.active if q.name == name]
    for q in found:
        q.stop()
    return bool(found)


def groups(spark: SparkSession, location: str, side: str) -> list[str]:
    """Names of a side's groups that readers see."""
    names = [x.split("=", 1)[1] for x in files.children(spark, f"{location}/{side}") if x.startswith(f"{GROUP}=")]
    merged, pending = commits(spark, location), set(files.children(spark, f"{location}/_pending"))
    if side == "rt":
        gone = {g for own in merged.values() for g in own}
        return [g for g in names if g not in gone]
    return [g for g in names if g in merged or g not in pending]


def commits(spark: SparkSession, location: str) -> dict[str, list[str]]:
    """By history group the batches that it replaces, as far as they aren't cleaned away."""
    folder = f"{location}/_merged"
    return {x.removesuffix(".json"): files.get_json(spark, f"{folder}/{x}") for x in files.children(spark, folder) if x.endswith(".json")}


def _read(spark: SparkSession, location: str, side: str, spec: TableSpec) -> DataFrame | None:
    """The side's rows with their group, by a schema from the specification; None if it has no groups."""
    names = groups(spark, location, side)
    if not names:
        return None
    schema = spec.schema
    if spec.agg.grouping and any(m.agg in ("first", "last") for m in spec.agg.metrics):
        schema = schema.add(FIRST_SEQ, "decimal(38,0)").add(LAST_SEQ, "decimal(38,0)")
    df = spark.read.option("basePath", f"{location}/{side}").schema(schema.add(GROUP, "string")).parquet(*[f"{location}/{side}/{GROUP}={g}" for g in names])
    return df


def fresh(spark: SparkSession, location: str, spec: TableSpec) -> DataFrame:
    """Rows of the realtime groups; one dims combination may be in several of them."""
    df = _read(spark, location, "rt", spec)
    return df if df is not None else spark.createDataFrame([], spec.schema.add(GROUP, "string"))


def merge(spark: SparkSession, location: str, spec: TableSpec, target: str, *, clean: bool = True) -> list[str]:
    """All realtime groups rolled up into one history group named ``target``; returns the groups. Readers see either all of them or the new one."""
    names = groups(spark, location, "rt")
    if not names:
        return []
    if files.exists(spark, f"{location}/hist/{GROUP}={target}"):
        raise ValueError(f"there is a history group {target}")
    df = fresh(spark, location, spec).drop(GROUP)
    df = rollup(df, spec.agg, keep_seq=FIRST_SEQ in df.columns) if spec.agg.grouping else df
    if spec.agg.dims:
        df = df.sortWithinPartitions(*spec.agg.dims)
    files.put_json(spark, f"{location}/_pending/{target}", names)
    df.write.mode("overwrite").parquet(f"{location}/hist/{GROUP}={target}")
    files.put_json(spark, f"{location}/_merged/{target}.json", names)
    if clean:
        settle(spark, location)
    return names


def settle(spark: SparkSession, location: str) -> None:
    """Clean up after merges: batches that were replaced go, and so do history groups whose merge was broken off."""
    merged = commits(spark, location)
    for target, names in merged.items():
        for g in names:
            files.delete(spark, f"{location}/rt/{GROUP}={g}")
        files.delete(spark, f"{location}/_pending/{target}")
        files.delete(spark, f"{location}/_merged/{target}.json")
    for target in files.children(spark, f"{location}/_pending"):
        if target not in merged and not target.endswith(".new"):
            files.delete(spark, f"{location}/hist/{GROUP}={target}")
        files.delete(spark, f"{location}/_pending/{target}")


def hybrid(spark: SparkSession, location: str, spec: TableSpec) -> DataFrame:
    """Realtime and history together; a group in both counts from the realtime side. Readers still aggregate.

    Columns come from the specification: those that older files lack are NULL.
    """
    parts = [df for side in ("rt", "hist") if (df := _read(spark, location, side, spec)) is not None]
    if not parts:
        return spark.createDataFrame([], spec.schema)
    both = parts[0] if len(parts) == 1 else storage.hybrid(parts[0], parts[1], GROUP)
    return both.select(*[c.name for c in spec.columns])


def to_history(spark: SparkSession, location: str, spec: TableSpec, path: str, partition: str, value: str, *, select: dict[str, str] | None = None, where: str | None = None) -> list[str]:
    """Move realtime rows into history partitions at ``path``; returns the groups that moved.

    value: the partition by an SQL expression; select: SQL expressions by column, for those
    that are computed on the way; where: only rows for which it holds go over, the others
    are dropped with their groups. Batches that come in meanwhile stay.
    """
    names = groups(spark, location, "rt")
    if not names:
        return []
    rows = fresh(spark, location, spec)
    if where:
        rows = rows.where(where)
    key = F.expr(value)
    rows = rows.withColumn(partition, key).withColumns({c: F.expr(e) for c, e in (select or {}).items()})
    keep = [c for c in (FIRST_SEQ, LAST_SEQ) if c in rows.columns]
    token = names[-1]
    done = files.children(spark, f"{path}/_moved")
    if token not in done:  # a repeated call after a failure doesn't add the rows again
        storage.write(rows.select(*[c.name for c in spec.columns], *keep, partition), path, spec, mode="append", partition_by=(partition,), keep_seq=bool(keep))
        files.put_json(spark, f"{path}/_moved/{token}", names)
    for g in names:
        files.delete(spark, f"{location}/rt/{GROUP}={g}")
    files.delete(spark, f"{path}/_moved/{token}")
    return names
