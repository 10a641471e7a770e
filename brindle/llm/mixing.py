"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gives its i-th block between slot floor((i-1)/w), its
release, and slot ceil(i/w), its deadline; every slot goes to the released block
with the earliest deadline. Each source is then less than one block from its
target at every slot. Releases and deadlines follow from the exact weights, as
fractions, over the whole length; one task schedules all blocks in turn, holding
one block a source.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Documents a block, slots given out at a time, least number of hash buckets within which a source's documents are ranked, exponent of the default weights.
BLOCK, PERIOD, BUCKETS, TEMPER = 64, 4096, 1024, 0.7
#: Documents of all sources a hash bucket at most, on average; more documents make more buckets.
RANKED = 16_384
#: Up to so many blocks are broadcast to where the documents are; more are shuffled.
BROADCAST = 300_000


def places(sizes: dict, weights: dict, block: int = BLOCK):
    """(source, block, slot, exact) of every block of the sources with a positive weight, in the order of the slots.

    ``sizes``: documents by source. Exact until the first slot for which a source lacks
    a whole block. From there on a source that has run out leaves its slots to the others,
    which keep their releases and deadlines; slots that none is released for stay empty.
    """
    names = sorted((k for k, n in sizes.items() if n > 0 and weights.get(k, 0) > 0), key=lambda k: (str(k), k is None))
    parts_of = [Fraction(weights[k]) for k in names]
    whole = lcm(*[x.denominator for x in parts_of])
    w = [x.numerator * (whole // x.denominator) for x in parts_of]
    total = sum(w)
    full, last = [sizes[k] // block for k in names], [-(-sizes[k] // block) for k in names]
    waiting: list = []
    ready = [(-(-total // w[j]), j, 0) for j in range(len(names))]
    heapq.heapify(ready)
    slot, exact = 0, True
    while ready or waiting:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, j, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // w[j]), j, i))
        deadline, j, i = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a deadline was missed")
        exact = exact and i < full[j]
        if i < last[j]:
            yield names[j], i, slot, exact
        if exact or i + 1 < last[j]:
            heapq.heappush(waiting, ((i + 1) * total // w[j], j, i + 1))
        slot += 1


def mix(docs: DataFrame, *, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, period: int = PERIOD, buckets: int | None = None, temper: float = TEMPER, keep: tuple[str, ...] = (), tie_col: str | None = None) -> DataFrame:
    """Place of every document in the mix; none is dropped or repeated.

    Columns: id, source, those of ``keep``, block (of its source), slot, seq (within the
    block) and exact. Reading in the order (slot, seq) interleaves the blocks; up to the
    slot where a first source has run out (``exact``) every source is less than a block
    from its target, after it the other sources keep to their targets and the slots of that source are
    theirs or empty.
    ``weights``: by source; without them the sources' sizes to the power ``temper``.
    A null source is one source of its own (weights key None); a source without a
    positive weight comes after all slots (slot null, exact false). Documents of a source
    are ordered by a hash of their id, rows that share an id by the
    hash of ``tie_col``, in any order without it.
    ``period``: slots that the scheduling task gives out at a time. The number of sources
    isn't bounded; the driver and that task hold a number for each that has a weight.
    """
    flat = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), *[F.col(c).alias(f"__k_{c}") for c in keep], F.xxhash64(F.col(tie_col)).alias("__tie") if tie_col else F.lit(0).alias("__tie"))
    if buckets is None:  # so many that one holds some ten thousand documents, however many there are
        buckets = max(BUCKETS, flat.count() // RANKED)
    flat = flat.withColumn("__hash", F.xxhash64("__id")).withColumn("__bucket", F.pmod("__hash", F.lit(buckets)).cast("int"))
    # a source's documents are ranked bucket by bucket, so that none is ranked in one task
    sizes = flat.groupBy("__source", "__bucket").agg(F.count("*").alias("n"))
    spark = docs.sparkSession
    known = sizes
    if weights:
        wanted = spark.createDataFrame([(None if k is None else str(k),) for k in weights], "ws string")
        known = sizes.join(F.broadcast(wanted), F.col("__source").cast("string").eqNullSafe(F.col("ws")), "left_semi")
    per_source = {r[0]: r[1] for r in known.groupBy("__source").agg(F.sum("n")).collect()}
    given = weights if weights is not None else {k: n**temper for k, n in per_source.items()}
    given = {k: w for k, w in given.items() if k in per_source}
    base = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select(F.col("__source").alias("s"), F.col("__bucket").alias("b"), F.coalesce("before", F.lit(0)).alias("before"))
    ranked = flat.withColumn("__rank", F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__hash", "__id", "__tie")) - 1)
    ranked = ranked.join(base, ranked["__source"].eqNullSafe(base["s"]) & (ranked["__bucket"] == base["b"])).drop("s", "b")
    ranked = ranked.withColumn("__at", F.col("before") + F.col("__rank")).withColumn("block", F.floor(F.col("__at") / block)).withColumn("seq", (F.col("__at") % block).cast("int"))
    out = [F.col("__id").alias(id_col), F.col("__source").alias(source_col), *[F.col(f"__k_{c}").alias(c) for c in keep], "block", "slot", "seq", F.coalesce("exact", F.lit(False)).alias("exact")]
    if not any(w > 0 for w in given.values()):
        return ranked.withColumn("slot", F.lit(None).cast("bigint")).withColumn("exact", F.lit(False)).select(*out)
    def run(batches):
        for _ in batches:
            rows: list = []
            for k, i, slot, exact in places(per_source, given, block):
                rows.append((None if k is None else str(k), i, slot, exact))
                if len(rows) == period:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([("s", pa.string()), ("i", pa.int64()), ("slot", pa.int64()), ("exact", pa.bool_())])
    table = spark.range(0, 1, 1, 1).mapInArrow(run, "s string, i bigint, slot bigint, exact boolean")
    if sum(-(-per_source[k] // block) for k, w in given.items() if w > 0) <= BROADCAST:
        table = F.broadcast(table)
    ranked = ranked.join(table, ranked["__source"].cast("string").eqNullSafe(table["s"]) & (ranked["block"] == table["i"]), "left").drop("s", "i")
    return ranked.select(*out)


def reorder(docs: DataFrame, *, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **more) -> DataFrame:
    """The documents with their own columns, in the order of the mix (across and within partitions, so across and within the files written from it).

    What is placed is stored before it is sorted, so that the texts lie in one shuffle at a time.
    """
    cols = docs.columns
    flat = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in cols])).select(F.col(id_col).alias("__i"), F.col(source_col).alias("__s"), F.col(text_col).alias("__t"), "__row")
    placed = Scratch(docs.sparkSession).store(mix(flat, weights=weights, id_col="__i", source_col="__s", keep=("__row",), tie_col="__t", **more), "placed")
    return placed.orderBy(F.col("slot").asc_nulls_last(), "__s", "block", "seq").select(*[F.col(f"__row.`{c}`").alias(c) for c in cols])
