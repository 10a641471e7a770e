"""Similar pairs among items that share bucket keys, for the join operators.

An item has a few keys; items that share one are candidates. A large bucket is
cut into blocks, and each pair of blocks is a cell of its own, so no task gets
more than two blocks. A pair is looked at in one bucket only, that of its least
common key. First, light rows tell which items have such a pair in a cell at
all; then only these bring their sets there, and all their pairs are compared
exactly. What comes out is linear: links by item and a forest of edges.

Where only the forest is wanted, items of large buckets are first compared with
one item of the bucket, its pivot. What is like the pivot is in one component
already, so pairs among it need no look: a bucket of copies with small changes
costs its size, not the square of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, components, hot_join

#: Items a block. Tokens worked on at once when sets are compared. Items of a bucket from which on it has a pivot; pivots an item is compared with.
BLOCK, TOKENS, LARGE, PIVOTS = 1024, 4096, 128, 3
#: Up to so many pairs of a cell are compared one by one, more by products of matrices.
FEW_PAIRS = 40
#: Bytes of a sketch, and the share that must agree; of 64 a pair at 0.8 has 51 on average with a deviation of 3.2, of 48 it has 38 with 2.8.
SKETCH, AGREE = 64, 0.53


def values(b: pa.RecordBatch) -> list[list]:
    return [c.to_pylist() for c in b.columns]


def arrays(c: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column without nulls, as arrays."""
    flat, at = c.flatten().to_numpy(), c.offsets.to_numpy()
    at = (at - at[0]).tolist()
    return [flat[s:e] for s, e in zip(at, at[1:], strict=False)]


def pieces(batches, rows: int = 256, size: int = 1 << 22):
    """Batches cut until they have few rows and bytes, or one row."""
    for b in batches:
        if b.num_rows > 1 and (b.num_rows > rows or b.nbytes > size):
            half = b.num_rows // 2
            yield from pieces((b.slice(0, half), b.slice(half)), rows, size)
        else:
            yield b


def groups(batches, width: int, columns=values):
    """Runs of rows that agree in the first ``width`` columns (integers without nulls) of sorted batches, as lists of columns."""
    held: list[list] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = columns(b)
        numbers = [b.column(i).to_numpy() for i in range(width)]
        new = np.zeros(b.num_rows, bool)
        for c in numbers:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.nonzero(new)[0].tolist(), b.num_rows]
        for s, e in zip(edges, edges[1:], strict=False):
            part = [c[s:e] for c in cols]
            if held is not None and all(held[i][0] == part[i][0] for i in range(width)):
                for x, y in zip(held, part, strict=True):
                    x += y
            else:
                if held is not None:
                    yield held
                held = part
    if held is not None:
        yield held


class Rows:
    """Collects rows and gives them back as batches."""

    def __init__(self, schema: pa.Schema, size: int = 4096):
        self.schema, self.size, self.cols = schema, size, [[] for _ in schema]

    def add(self, cols) -> None:
        for x, y in zip(self.cols, cols, strict=True):
            x += y

    def full(self) -> bool:
        return len(self.cols[0]) >= self.size

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, self.schema, strict=True)], schema=self.schema)
        self.cols = [[] for _ in self.schema]
        return out


def lesser(keys: np.ndarray, key: int) -> list[int]:
    """What comes before ``key`` in a sorted array."""
    return keys[: keys.searchsorted(key)].tolist()


def own_pairs(key: int, keys: list[np.ndarray], blk: np.ndarray, one: int, two: int) -> np.ndarray:
    """Upper triangle of the pairs whose least common key is this bucket's, across the cell's two blocks."""
    m = len(keys)
    less = [lesser(ks, key) for ks in keys]
    ok = np.triu(np.ones((m, m), bool), 1)
    if one != two:
        ok &= blk[:, None] != blk[None, :]
    names = {k: i for i, k in enumerate(sorted({k for ks in less for k in ks}))}
    if names:
        for at in range(0, len(names), TOKENS):
            x = np.zeros((m, min(TOKENS, len(names) - at)), np.float32)
            for i, ks in enumerate(less):
                for k in ks:
                    if 0 <= (j := names[k] - at) < x.shape[1]:
                        x[i, j] = 1
            ok &= x @ x.T == 0
    return ok


def pair_here(key: int, keys: list[np.ndarray], blk: list[int], one: int, two: int) -> bool:
    """The same for a cell of two items."""
    if one != two and blk[0] == blk[1]:
        return False
    return set(lesser(keys[0], key)).isdisjoint(lesser(keys[1], key))


def in_both(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sets of words."""
    z = np.concatenate((x, y))
    z.sort()
    return int(np.count_nonzero(z[1:] == z[:-1]))


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every two sets of words."""
    m = len(sets)
    flat = np.concatenate(sets) if m else np.empty(0, np.uint64)
    words, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = np.full(len(words), -1)
    shared[times > 1] = np.arange((times > 1).sum())
    col = shared[at]
    row, col = row[col >= 0], col[col >= 0]
    out = np.zeros((m, m), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for start in range(0, int((times > 1).sum()), TOKENS):
        s, e = np.searchsorted(col, [start, start + TOKENS])
        x = np.zeros((m, TOKENS), np.float32)
        x[row[s:e], col[s:e] - start] = 1
        out += x @ x.T
    return out


def roots(similar: np.ndarray) -> np.ndarray:
    """Least index of each item's component in a symmetric relation."""
    m = len(similar)
    label = np.arange(m)
    linked = similar | np.eye(m, dtype=bool)
    while True:
        new = np.where(linked, label[None, :], m).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def alike(x: bytes, y: bytes) -> bool:
    return np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) >= AGREE * len(x)


def reaches(both: int, x: int, y: int, threshold: float) -> bool:
    """Jaccard similarity of sets of x and y words with ``both`` common ones, in whole numbers: at the threshold itself there is no rounding."""
    return both > 0 and both * 1000 >= (x + y - both) * round(threshold * 1000)


def cells_of(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Rows (key, id, blk, low, high) laid into the cells of their block and each of the blocks low to high."""
    rows = rows.withColumn("other", F.explode(F.sequence("low", "high")))
    cells = rows.select("key", F.least("blk", "other").alias("one"), F.greatest("blk", "other").alias("two"), "blk", "id", *extra)
    return cells.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")


def pivot_edges(scratch: Scratch, large: DataFrame, body: DataFrame, to_set, threshold: float, name: str) -> DataFrame:
    """(a, b): items of large buckets that are like the pivot of one of their largest buckets, with that pivot."""
    kind = large.schema["id"].dataType.simpleString()
    best = large.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("m", "key", "pivot")), False).alias("own"))
    near = best.select("id", F.explode(F.array_distinct(F.slice(F.col("own.pivot"), 1, PIVOTS))).alias("pivot")).where("id <> pivot")
    near = scratch.store(near.join(body.select("id", "body"), "id"), f"{name}-near")
    pivots = near.groupBy("pivot").agg(F.count("*").alias("n")).join(body.select(F.col("id").alias("pivot"), F.col("body").alias("other")), "pivot")
    both = hot_join(scratch, near, pivots, ["pivot"], "n", f"{name}-pivots").select("id", "pivot", "body", "other")
    ids = to_arrow_type(large.schema["id"].dataType)

    def compare(batches):
        sets: dict = {}
        for b in batches:
            got: tuple[list, list] = [], []
            for i, p, x, y in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (own := sets.get(p)) is None:
                    if len(sets) >= 64:
                        sets.clear()
                    own = sets[p] = to_set(p, y)
                s = to_set(i, x)
                if reaches(in_both(s, own), len(s), len(own), threshold):
                    got[0].append(i)
                    got[1].append(p)
            yield pa.RecordBatch.from_arrays([pa.array(c, ids) for c in got], names=["a", "b"])

    out = scratch.store(both.mapInArrow(compare, f"a {kind}, b {kind}"), f"{name}-pivot-edges")
    scratch.drop_named(f"{name}-near", f"{name}-pivots")
    return out


def unlike_rows(scratch: Scratch, large: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """What remains of large buckets: rows in blocks such that items in their pivot's component meet only those outside of it."""
    roots = components(scratch, edges, f"{name}-labels")
    rows = large.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    rows = scratch.store(rows, f"{name}-labelled")
    of_key = rows.where("id = pivot").select("key", F.col("label").alias("top"), "m")
    rows = hot_join(scratch, rows.drop("m"), of_key, ["key"], "m", f"{name}-tops").withColumn("inside", F.col("label") == F.col("top")).select("key", "id", "inside")
    rows = scratch.store(rows, f"{name}-inside")
    sizes = rows.groupBy("key").agg(F.count_if("inside").alias("g"), F.count_if(~F.col("inside")).alias("r")).where("r > 0").withColumn("m", F.col("g") + F.col("r"))
    rows = hot_join(scratch, rows, sizes, ["key"], "m", f"{name}-sides")
    ng, nr = F.ceil(F.col("g") / BLOCK).cast("int"), F.ceil(F.col("r") / BLOCK).cast("int")
    own = F.xxhash64("id")
    blk = F.when(F.col("inside"), F.pmod(own, F.greatest(ng, F.lit(1)))).otherwise(ng + F.pmod(own, nr)).cast("int")
    return rows.select("key", "id", blk.alias("blk"), F.when(F.col("inside"), ng).otherwise(F.lit(0)).alias("low"), (ng + nr - 1).alias("high"))


def similar_pairs(scratch: Scratch, keyed: DataFrame, light: DataFrame, bodies, to_set, threshold: float, name: str, *, links: bool = True, to_sets=None) -> tuple[DataFrame | None, DataFrame]:
    """(links, edges) of the items whose sets have a Jaccard similarity of ``threshold`` at least.

    keyed: distinct (key bigint, id), a stored table, or only the keys of several items with
    m, their number, and pivot, one of them; light: (id, n, sketch) that rules
    out most unlike pairs; bodies(ids): DataFrame (id, copies, body) of the items in
    ``ids``; to_set(id, body): the item's set as unsigned words, each once; to_sets(ids,
    bodies): the same for many items, where that is faster.
    links: (id, n) - copies of other similar items, None unless asked for; edges: (a, b),
    a forest that connects what is similar.
    """
    kind = keyed.schema["id"].dataType.simpleString()
    rows = keyed
    if "m" not in keyed.columns:
        sizes = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min_by("id", F.xxhash64("id", "key")).alias("pivot")).where("m > 1")
        rows = scratch.store(hot_join(scratch, keyed, sizes, ["key"], "m", f"{name}-sizes"), f"{name}-rows")
        scratch.drop_named(f"{name}-sizes")
    lists = rows.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys")).join(light, "id")
    lists = scratch.store(lists, f"{name}-lists")
    extra = ["keys", "n", "sketch"]
    own_block = F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / BLOCK)).cast("int")
    plain = rows if links else rows.where(F.col("m") <= LARGE)
    plain = plain.select("key", "id", own_block.alias("blk"), F.lit(0).alias("low"), (F.ceil(F.col("m") / BLOCK).cast("int") - 1).alias("high"))

    ids = to_arrow_type(keyed.schema["id"].dataType)
    need_schema = pa.schema([("key", pa.int64()), ("one", pa.int32()), ("two", pa.int32()), ("blk", pa.int32()), ("id", ids), ("keys", pa.list_(pa.int64()))])

    def needed(batches):
        out = Rows(need_schema)
        for t in groups(batches, 3, lambda b: [arrays(c) if i == 5 else c.to_pylist() for i, c in enumerate(b.columns)]):
            m = len(t[0])
            if m < 2:
                continue
            key, one, two = t[0][0], t[1][0], t[2][0]
            if m == 2:
                use = pair_here(key, t[5], t[3], one, two) and min(t[6]) >= threshold * max(t[6]) and alike(t[7][0], t[7][1])
                at = [0, 1] if use else []
            else:
                ok = own_pairs(key, t[5], np.array(t[3]), one, two)
                n = np.array(t[6], np.float64)
                ok &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
                if ok.any():
                    sk = np.frombuffer(b"".join(t[7]), np.uint8).reshape(m, -1)
                    i, j = np.nonzero(ok)
                    for at in range(0, len(i), 1 << 16):
                        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                        ok[x, y] = (sk[x] == sk[y]).sum(1) >= AGREE * sk.shape[1]
                at = np.nonzero(ok.any(0) | ok.any(1))[0].tolist()
            if at:
                out.add([[c[i] for i in at] for c in t[:6]])
                if out.full():
                    yield out.take()
        yield out.take()

    def met(own: DataFrame, label: str) -> DataFrame:
        return scratch.store(cells_of(own.join(lists, "id"), extra).mapInArrow(needed, f"key bigint, one int, two int, blk int, id {kind}, keys array<bigint>"), f"{name}-{label}")

    need = met(plain, "cells")
    wanted = need.select("id").distinct()
    large = None if links else rows.where(F.col("m") > LARGE)
    if large is not None and large.isEmpty():
        large = None
    if large is not None:
        wanted = wanted.unionByName(large.select("id")).distinct()
    body = bodies(wanted)
    forest = None
    if large is not None:
        forest = pivot_edges(scratch, large, body, to_set, threshold, name)
        need = need.unionByName(met(unlike_rows(scratch, large, forest, name), "more-cells"))
    full = need.join(body, "id").select("key", "one", "two", "blk", "id", "keys", "copies", "body")
    full = full.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")

    link_schema = pa.schema([("id", ids), ("root", ids), ("n", pa.int64())])

    def with_sets(b: pa.RecordBatch) -> list[list]:
        cols = [arrays(c) if i == 5 else c.to_pylist() for i, c in enumerate(b.columns)]
        cols[7] = to_sets(cols[4], cols[7]) if to_sets else [to_set(i, x) for i, x in zip(cols[4], cols[7], strict=True)]
        return cols

    def compare(batches):
        out = Rows(link_schema)
        for t in groups(pieces(batches), 3, with_sets):
            m = len(t[0])
            if m < 2:
                continue
            key, one, two = t[0][0], t[1][0], t[2][0]
            if m == 2:
                if not pair_here(key, t[5], t[3], one, two):
                    continue
                x, y = t[7]
                if reaches(in_both(x, y), len(x), len(y), threshold):
                    out.add([t[4], [t[4][0]] * 2, [t[6][1], t[6][0]]])
            else:
                ok = own_pairs(key, t[5], np.array(t[3]), one, two)
                sets = t[7]
                i, j = np.nonzero(ok)
                if len(i) <= FEW_PAIRS:
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        ok[x, y] = reaches(in_both(sets[x], sets[y]), len(sets[x]), len(sets[y]), threshold)
                else:
                    size = np.array([len(s) for s in sets], np.float32)
                    both = common(sets)
                    either = size[:, None] + size[None, :] - both
                    # in whole numbers: at the threshold itself there is no rounding
                    ok &= (both.astype(np.int64) * 1000 >= either.astype(np.int64) * round(threshold * 1000)) & (either > 0)
                if not ok.any():
                    continue
                ok |= ok.T
                n = ok @ np.array(t[6], np.float64)
                root = roots(ok)
                at = np.nonzero(ok.any(1))[0].tolist()
                out.add([[t[4][i] for i in at], [t[4][root[i]] for i in at], [int(n[i]) for i in at]])
            if out.full():
                yield out.take()
        yield out.take()

    got = scratch.store(full.mapInArrow(compare, f"id {kind}, root {kind}, n bigint"), f"{name}-links")
    scratch.drop_named(*[f"{name}-{x}" for x in ("cells", "more-cells", "rows", "lists", "labelled", "inside", "tops", "sides")])
    edges = got.select(F.col("id").alias("a"), F.col("root").alias("b"))
    if forest is not None:
        edges = edges.unionByName(forest)
    return got.groupBy("id").agg(F.sum("n").alias("n")) if links else None, edges
