"""N-gram Jaccard join by chosen paths.

In each run a set samples some of its tokens by a hash that all sets share, so
similar sets pick common ones; sets that picked the same token share a bucket.
A bucket that is still large is split again by the next sampled tokens of its
sets, level after level, unless most of it is like one of its sets: then nothing
would split it. What remains is compared exactly, large or small. Runs are repeated
until a pair at the threshold is missed with less than the wanted probability.

An item of the join is a different set, known by its digest; documents with the
same set are its copies.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, U64, Scratch, components, hot_join, mix64, remember, runs_hash, slices, sorted_set, text_or_empty
from .pairs import SKETCH, alike, similar_pairs

#: Words a shingle, least similarity, expected tokens a set samples at a node, buckets up to this size aren't split.
WORDS, THRESHOLD, PICK, SMALL = 5, 0.8, 2.0, 1024
#: Levels of a path at most; a bucket that is still large there is compared as it is. Share of a bucket like its pivot from which on it isn't split.
LEVELS, DENSE = 6, 0.5
#: Greatest wanted probability that a pair at the threshold is missed, however deep its buckets are split.
MISS = 1e-3
WORD = re.compile(r"\w+")


def recall(threshold: float = THRESHOLD, pick: float = PICK) -> float:
    """Least probability that one run finds a pair at the threshold at any depth: a branching process of shared picks survives.

    Fewest picks are shared where one set contains the other, as both pick at the rate of the larger one.
    """
    p = 1.0
    for _ in range(200):
        p = 1 - math.exp(-pick * threshold * p)
    return p


def runs_needed(miss: float = MISS, threshold: float = THRESHOLD, pick: float = PICK) -> int:
    if pick * threshold <= 1.05:
        raise ValueError("a set must sample more tokens, or paths of similar sets part")
    return math.ceil(math.log(miss) / math.log(1 - recall(threshold, pick)))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    """The set of hashed runs of k words of the whole text, sorted; a shorter text with words is one run."""
    h = xxhash.xxh3_64_intdigest
    w = np.array([h(x) for x in words_of(text)], U64)
    if not len(w):
        return w
    return sorted_set(runs_hash(w, min(k, len(w))))


_ODD = (mix64(np.arange(1, SKETCH + 1, dtype=U64) * MIX) | U64(1)).astype(np.uint32)[:, None]
_ADD = mix64(np.arange(1001, SKETCH + 1001, dtype=U64) * MIX).astype(np.uint32)[:, None]


def sketch(s: np.ndarray) -> bytes:
    """A byte each of SKETCH minwise hashes, multiplied in 32 bits."""
    low, out = s.astype(np.uint32)[None, :], np.empty(SKETCH, np.uint8)
    step = max(4, min(SKETCH, (1 << 15) // len(s)))  # what is worked on at once stays in the cache
    for at in range(0, SKETCH, step):
        out[at : at + step] = ((low * _ODD[at : at + step] + _ADD[at : at + step]).min(1) >> np.uint32(4)).astype(np.uint8)
    return out.tobytes()


def roots_of(runs: int) -> np.ndarray:
    """The nodes at which the runs begin."""
    return mix64((np.arange(runs, dtype=U64) + U64(1)) * MIX)


def children(s: np.ndarray, nodes: np.ndarray, pick: float = PICK) -> np.ndarray:
    """Nodes below these that the set chooses, each once.

    A token is chosen at a node if its 32-bit hash with the node is less than
    pick / size. The new node mixes the token's whole hash with the one above.
    """
    bound, low = np.uint32(min(2**32 - 1, int(pick / len(s) * 2**32))), s.astype(np.uint32)[None, :]
    odd, add = (nodes | U64(1)).astype(np.uint32)[:, None], (nodes >> U64(32)).astype(np.uint32)[:, None]
    out, step = [], max(4, (1 << 15) // len(s))
    for at in range(0, len(nodes), step):
        i, j = np.nonzero(low * odd[at : at + step] + add[at : at + step] <= bound)
        out.append(mix64(s[j] * MIX + nodes[i + at]))
    return sorted_set(np.concatenate(out)).view(np.int64)


def profile(docs: DataFrame, id_col: str, text_col: str, k: int, runs: int) -> DataFrame:
    """One row a document: id, t (hash of its text), d (digest of its set, null without words), n, keys, sketch. Copies in a batch are worked on once."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        remember("join")
        top, none = roots_of(runs), np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            for b in slices(batches, 256):
                rows, seen = [], {}
                for text in b.column(2).to_pylist():
                    if text not in seen:
                        s = shingles(text, k)
                        seen[text] = (hash128(s), len(s), children(s, top), sketch(s)) if len(s) else (None, 0, none, None)
                    rows.append(seen[text])
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True))], names=["id", "t", "d", "n", "keys", "sketch"])

    text = text_or_empty(text_col)
    return docs.select(id_col, F.xxhash64(text).alias("__t"), text.alias("__text")).mapInArrow(run, f"id {kind}, t bigint, d binary, n bigint, keys array<bigint>, sketch binary")


def hash128(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def with_sets(texts: DataFrame, words: int, make, schema: str) -> DataFrame:
    """Rows that ``make(set, keys)`` gives for the texts (d, keys, __text) whose set has the digest d; others with the same id and text hash fall out."""

    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        types = {"id": pa.binary(), "body": pa.binary(), "key": pa.int64(), "copies": pa.int64()}
        with np.errstate(over="ignore"):
            for b in slices(batches, 256):
                out = [[] for _ in names]
                for d, own, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    s = shingles(text, words)
                    if len(s) and hash128(s) == d:
                        for row in make(d, s, own):
                            for c, v in zip(out, row, strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, out, strict=True)], names=names)

    return texts.mapInArrow(run, schema)


def crowded(scratch: Scratch, members: DataFrame, reps: DataFrame, level: int) -> DataFrame:
    """(key): large buckets of which most sets are like the pivot, as far as sketches tell."""
    own = members.join(reps.select(F.col("d").alias("id"), "sketch"), "id").select("key", "id", "pivot", "m", "sketch")
    own = scratch.store(own, f"sketched-{level}")
    pivots = own.where("id = pivot").select("key", F.col("sketch").alias("other"), "m")
    both = hot_join(scratch, own.drop("m"), pivots, ["key"], "m", f"pivots-{level}").select("key", "sketch", "other")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(alike(x, y)) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.float64())], names=["key", "like"])

    return both.mapInArrow(run, "key bigint, like double").groupBy("key").agg(F.avg("like").alias("like")).where(F.col("like") >= DENSE).select("key")


def buckets(scratch: Scratch, reps: DataFrame, texts_of, words: int, small: int) -> DataFrame:
    """(key, id): the bucket keys with two sets at least, after large buckets were split."""
    rows = scratch.store(reps.select(F.col("d").alias("id"), F.explode("keys").alias("key")), "level-0")
    out = None
    for level in range(LEVELS):
        sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.min_by("id", F.xxhash64("id", "key")).alias("pivot")).where("m > 1")
        rows = scratch.store(hot_join(scratch, rows, sizes, ["key"], "m", f"sizes-{level}"), f"rows-{level}")
        scratch.drop_named(f"level-{level}", f"sizes-{level}")
        members = rows.where(F.col("m") > small)
        if level + 1 == LEVELS or members.isEmpty():
            got = rows.select("key", "id")
            return got if out is None else out.unionByName(got)
        whole = scratch.store(crowded(scratch, members, reps, level), f"whole-{level}")  # fewer than the buckets, each of over ``small`` sets
        got = rows.where(F.col("m") <= small).select("key", "id").unionByName(members.join(whole, "key", "left_semi").select("key", "id"))
        out = got if out is None else out.unionByName(got)
        split = members.join(whole, "key", "left_anti").groupBy("id").agg(F.collect_set("key").alias("own"))

        def below(d, s, own):
            return [(d, k) for k in children(s, np.array(own, np.int64).view(U64)).tolist()]

        rows = scratch.store(with_sets(texts_of(split), words, below, "id binary, key bigint").distinct(), f"level-{level + 1}")
        scratch.drop_named(f"sketched-{level}", f"pivots-{level}")
    raise AssertionError


def grouped(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, miss: float, small: int, links: bool) -> tuple[DataFrame, DataFrame]:
    """(rows: id, t, d of every document; sets: d, copies, n_links, top, the least (id, t) of the set's class)."""
    known = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("__text"))
    rows = scratch.store(profile(known, "id", "__text", words, runs_needed(miss, threshold)), "profile")
    # copies become one item before anything is dealt out by key
    reps = rows.where("d is not null").groupBy("d").agg(F.min(F.struct("id", "t")).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "keys", "sketch")])
    reps = scratch.store(reps, "reps")
    keyless = known.withColumn("t", F.xxhash64("__text"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(d, own, __text) of the first document of each wanted set."""
        first = wanted.join(reps.select(F.col("d").alias("id"), "first"), "id").select(F.col("id").alias("d"), "own", F.col("first.id").alias("i"), F.col("first.t").alias("h"))
        return keyless.join(first, keyless["id"].eqNullSafe(first["i"]) & (keyless["t"] == first["h"])).select("d", "own", "__text")

    keyed = scratch.store(buckets(scratch, reps, texts_of, words, small), "keyed")
    scratch.drop_named(*[f"rows-{k}" for k in range(LEVELS)])

    def bodies(ids: DataFrame) -> DataFrame:
        wanted = ids.join(reps.select(F.col("d").alias("id"), "copies"), "id").select("id", F.col("copies").alias("own"))
        got = with_sets(texts_of(wanted), words, lambda d, s, own: [(d, own, s.tobytes())], "id binary, copies bigint, body binary")
        return scratch.store(got.groupBy("id").agg(F.max("copies").alias("copies"), F.first("body").alias("body")), "bodies")  # repeated rows of a first document

    light = reps.select(F.col("d").alias("id"), "n", "sketch")
    found, edges = similar_pairs(scratch, keyed, light, bodies, lambda i, b: np.frombuffer(b, U64), threshold, "join", links=links)
    roots = components(scratch, edges)
    scratch.drop_named("keyed", "bodies", "join-pivot-edges")
    sets = reps.select("d", "first", "copies").join(roots.select(F.col("node").alias("d"), "root"), "d", "left").withColumn("part", F.coalesce("root", "d")).drop("root")
    sets = sets.join(found.select(F.col("id").alias("d"), F.col("n").alias("others")), "d", "left") if links else sets.withColumn("others", F.lit(0))
    sets = scratch.store(sets, "sets")
    parts = sets.groupBy("part").agg(F.min("first").alias("top"), F.count("*").alias("k"))
    own = hot_join(scratch, sets, parts, ["part"], "k", "parts")
    return rows.select("id", "t", "d"), own.select("d", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "top")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, miss: float = MISS, small: int = SMALL) -> DataFrame:
    """Self-join of whole texts on the Jaccard similarity of their word shingles.

    Columns: id, class_id (least id connected to it by links), n_links (other rows whose
    similarity reaches the threshold), n_copies (other rows with the same shingles).
    Words are compared in lower case; a text of fewer words than a shingle is one
    shingle. A text without words (null, empty, only signs) is like no other: it is
    its own class. Repeated rows, and rows that share an id, are rows of their own,
    compared by their texts. Null ids are ids like others and the least.
    """
    scratch = Scratch(docs.sparkSession)
    rows, sets = grouped(scratch, docs, id_col, text_col, words, threshold, miss, small, True)
    sets = sets.select("d", "copies", F.col("top.id").alias("class_id"), "n_links", (F.col("copies") - 1).alias("n_copies"))
    out = hot_join(scratch, rows.where("d is not null").select("id", "d"), sets, ["d"], "copies", "classes").select("id", "class_id", "n_links", "n_copies")
    zero = F.lit(0).cast("bigint")
    alone = rows.where("d is null").select("id", F.col("id").alias("class_id"), zero.alias("n_links"), zero.alias("n_copies"))
    return out.unionByName(alone).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, miss: float = MISS, small: int = SMALL) -> DataFrame:
    """One document of each class of similar ones, that with the least id (ties: the least hash of the text); the columns stay.

    Documents without words are classes of their own and stay. Rows that share an id and
    are unlike stay both; of rows with the same id and text one stays.
    """
    cols = docs.columns
    scratch = Scratch(docs.sparkSession)
    rows, sets = grouped(scratch, docs, id_col, text_col, words, threshold, miss, small, False)
    kept = sets.select("top.id", "top.t").distinct().unionByName(rows.where("d is null").select("id", "t").distinct())
    kept = kept.select(F.col("id").alias("__id"), F.col("t").alias("__h"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.col(id_col).alias("__own"), F.xxhash64(text_or_empty(text_col)).alias("__t"))
    one = own.join(kept, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__h")), "left_semi").dropDuplicates(["__own", "__t"])
    return one.select(*[F.col(f"__row.`{c}`").alias(c) for c in cols])
