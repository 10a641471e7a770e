"""Exact substring dedup by suffix order and longest-previous-factor arrays.

Every string of ``length`` bytes is assigned to the least hash among its shorter
grams, its anchor; equal strings have the same anchor at the same place, so only
places whose anchors match can repeat. Neighbouring strings with one anchor form
a block. Blocks that are equal byte by byte are settled by their digests, with
partial counts; of what remains under a shared anchor, one copy of each block is
sorted into suffix order, where the previous and next smaller positions give the
longest earlier match of every position (and, in reverse, the longest later one).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import U64, Scratch, hot_join, runs_hash, slices, text_or_empty
from .chunks import cut_out
from .pairs import groups

#: Bytes of a repeated string and of an anchor; bytes sorted into one suffix order; blocks an anchor may have there, else its strings are counted by digest.
LENGTH, ANCHOR, ORDER_BYTES, ORDER_BLOCKS = 200, 48, 1 << 19, 4096
PLACE = U64((1 << 24) - 1)


# ---- suffix order of bytes in memory

def levels(x: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all positions by their next 7, 14, 28 ... symbols up to ``depth``; beyond the end count zeros."""
    n = len(x)
    packed = np.zeros(n, U64)
    pad = np.concatenate([x.astype(U64), np.zeros(8, U64)])
    for i in range(7):  # symbols have 9 bits: a byte plus one, or zero
        packed = (packed << U64(9)) | pad[i : i + n]
    out = [(7, np.unique(packed, return_inverse=True)[1].astype(np.int64))]
    while out[-1][0] * 2 <= depth:
        h, r = out[-1]
        out.append((2 * h, pair_rank(r, h)))
    return out


def pair_rank(r: np.ndarray, shift: int) -> np.ndarray:
    then = np.full(len(r), -1, np.int64)
    then[: max(0, len(r) - shift)] = r[shift:]
    return np.unique(r * (len(r) + 1) + then + 1, return_inverse=True)[1].astype(np.int64)


def suffix_order(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array by the first ``depth`` symbols, ties by position; common prefix with the one before, at most ``depth``)."""
    ranks = levels(x, depth)
    h, r = ranks[-1]
    full = pair_rank(r, depth - h) if h < depth else r
    sa = np.argsort(full, kind="stable")
    a, b, n = sa[:-1], sa[1:], len(x)
    lcp = np.zeros(n, np.int64)
    at = np.zeros(max(0, n - 1), np.int64)
    for h, r in reversed(ranks):
        for _ in range(2):
            i, j = a + at, b + at
            ok = (i < n) & (j < n)
            ok[ok] = r[i[ok]] == r[j[ok]]
            at[ok] += h
    for _ in range(7):
        i, j = a + at, b + at
        ok = (i < n) & (j < n)
        ok[ok] = x[i[ok]] == x[j[ok]]
        at[ok] += 1
    lcp[1:] = np.minimum(np.minimum(at, depth), n - np.maximum(a, b))
    return sa, lcp


def smaller(values: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the previous smaller entry (-1: none) and the least of ``least`` in between (after it, up to the entry)."""
    n = len(values)
    at, low = np.arange(n) - 1, least.copy()
    todo = np.nonzero((at >= 0) & (low > 0))[0]
    while True:
        todo = todo[(at[todo] >= 0) & (low[todo] > 0)]
        todo = todo[values[at[todo]] > values[todo]]
        if not len(todo):
            break
        # what lies between is greater still, so one may jump on from there
        low[todo] = np.minimum(low[todo], low[at[todo]])
        at[todo] = at[at[todo]]
    low[at < 0] = 0
    return at, low


def farthest(values: np.ndarray, sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Of each position the longest match with one of a smaller value, from its neighbours in suffix order on both sides."""
    _, before = smaller(values, lcp)
    _, after = smaller(values[::-1].copy(), np.concatenate([lcp[1:], [0]])[::-1].copy())
    out = np.empty(len(sa), np.int64)
    out[sa] = np.maximum(before, after[::-1])
    return out


def previous_factors(x: np.ndarray, depth: int) -> np.ndarray:
    """Longest-previous-factor array, at most ``depth``: of each position the longest match with an earlier one."""
    if not len(x):
        return np.empty(0, np.int64)
    sa, lcp = suffix_order(x, depth)
    return farthest(sa, sa, lcp)


def other_factors(x: np.ndarray, depth: int) -> np.ndarray:
    """Of each position the longest match with any other one, at most ``depth``: earlier ones, or later ones by the mirrored order."""
    if not len(x):
        return np.empty(0, np.int64)
    sa, lcp = suffix_order(x, depth)
    return np.maximum(farthest(sa, sa, lcp), farthest(-sa, sa, lcp))


# ---- anchors

def blocks(data: bytes, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, first and last start of the strings) of each block of a text."""
    n = len(data)
    if n < length:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.frombuffer(data, np.uint8)
    span, outs = length - anchor + 1, []
    step = 1 << 23
    for base in range(0, n - length + 1, step):  # places have 24 bits; strings of neighbouring parts are cut apart
        part = x[base : base + step + length - 1]
        h = runs_hash(part, anchor)
        low = (h & ~PLACE) | np.arange(len(h), dtype=U64)
        size = 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :]) if span > size else low
        place = (low & PLACE).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        outs.append((h[place[first]], first + base, last + base))
    return tuple(np.concatenate(c) for c in zip(*outs, strict=True))


def block_table(docs: DataFrame, id_col: str, text_col: str, length: int, anchor: int) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        digest = xxhash.xxh3_128_digest
        with np.errstate(over="ignore"):
            for b in slices(batches, 128):
                cols, counts = [], []
                sums: list[bytes] = []
                for text in b.column(1).to_pylist():
                    data = text.encode()
                    h, s, e = blocks(data, length, anchor)
                    cols.append((h, s, e))
                    counts.append(len(h))
                    sums += [digest(data[i : j + length]) for i, j in zip(s.tolist(), e.tolist(), strict=True)]
                h, s, e = (np.concatenate(c) for c in zip(*cols, strict=True)) if cols else [np.empty(0, np.int64)] * 3
                two = np.frombuffer(b"".join(sums), np.int64)
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(U64).view(np.int64)), pa.array(two[::2].copy()), pa.array(two[1::2].copy()), ids, pa.array(s), pa.array(e)], names=["anchor", "d1", "d2", "doc", "first", "last"])

    return docs.select(id_col, text_or_empty(text_col).alias("__text")).mapInArrow(run, f"anchor bigint, d1 bigint, d2 bigint, doc {kind}, first bigint, last bigint")


def spans(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, length: int, anchor: int, keep: str) -> DataFrame:
    """(doc, s, e): bytes covered by a string of ``length`` bytes that starts elsewhere too (keep first: earlier too)."""
    kind = dict(docs.dtypes)[id_col]
    first_only = keep == "first"
    table = block_table(docs, id_col, text_col, length, anchor)
    # an anchor in one place only can't repeat; counts come together before the shuffle
    shared = table.groupBy("anchor").agg(F.count("*").alias("n"), F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.min("d2").alias("lo2"), F.max("d2").alias("hi2")).where("n > 1")
    shared = scratch.store(shared.select("anchor", ((F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2"))).alias("same")), "anchors")
    rows = scratch.store(table.join(shared, "anchor"), "blocks")
    scratch.drop(shared)
    copies = rows.groupBy("anchor", "d1", "d2", "same").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "last")).alias("rep"))
    copies = scratch.store(copies, "copies")
    equal = copies.where("n > 1").select("anchor", "d1", "d2", "n", "rep")
    whole = hot_join(scratch, rows, equal, ["anchor", "d1", "d2"], "n", "equal")
    if first_only:
        whole = whole.where(~(F.col("doc").eqNullSafe(F.col("rep.doc")) & (F.col("first") == F.col("rep.first"))))
    whole = whole.select("doc", F.col("first").alias("s"), (F.col("last") + length).alias("e"))
    # what remains: anchors with different blocks, one copy of each
    mixed = copies.where("not same").select("anchor", "n", "rep.*")
    wanted = mixed.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("anchor", "n", "first", "last")).alias("wanted"))
    texts = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("__text")).join(wanted, F.col("doc").eqNullSafe(F.col("__doc"))).select("doc", "__text", "wanted")

    def bodies(batches):
        for b in slices(batches, 128):
            out = {k: [] for k in ("anchor", "n", "row", "first", "body")}
            for i, (text, own) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                data = text.encode()
                for w in own:
                    if w["last"] + length <= len(data):
                        for k in ("anchor", "n", "first"):
                            out[k].append(w[k])
                        out["row"].append(i)
                        out["body"].append(data[w["first"] : w["last"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["n"], pa.int64()), b.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["first"], pa.int64()), pa.array(out["body"], pa.binary())], names=["anchor", "n", "doc", "first", "body"])

    segments = scratch.store(texts.mapInArrow(bodies, f"anchor bigint, n bigint, doc {kind}, first bigint, body binary"), "segments")
    crowded = scratch.store(segments.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > ORDER_BLOCKS).select("anchor"), "crowded")

    doc_type = to_arrow_type(docs.schema[id_col].dataType)

    def ordered(batches):
        """Suffix orders over several anchors at a time; strings of different anchors are never equal."""
        held: list[tuple] = []
        size = 0

        def flush():
            x = np.zeros(sum(len(r[3]) + 1 for r in held), np.int64)
            begin, at = [], 0
            for r in held:
                x[at : at + len(r[3])] = np.frombuffer(r[3], np.uint8).astype(np.int64) + 1
                begin.append(at)
                at += len(r[3]) + 1
            match = previous_factors(x, length) if first_only else other_factors(x, length)
            docs_, s_, e_ = [], [], []
            for r, a in zip(held, begin, strict=True):
                hit = np.nonzero(match[a : a + len(r[3]) - length + 1] >= length)[0]
                for i, j in runs(hit):
                    docs_.append(r[1])
                    s_.append(r[2] + i)
                    e_.append(r[2] + j + length)
            return pa.RecordBatch.from_arrays([pa.array(docs_, doc_type), pa.array(s_, pa.int64()), pa.array(e_, pa.int64())], names=["doc", "s", "e"])

        for t in groups(batches, 1):
            if len(t[0]) > 1:
                got = sorted(zip(*t[1:], strict=True), key=lambda r: (r[1]["i"] is not None, r[1]["i"], r[1]["t"], r[2]))
                held += got
                size += sum(len(r[3]) for r in got)
                if size > ORDER_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    few = segments.join(crowded, "anchor", "left_anti").select("anchor", "n", "doc", "first", "body").repartition("anchor").sortWithinPartitions("anchor")
    by_order = few.mapInArrow(ordered, f"doc {kind}, s bigint, e bigint")

    def windows(batches):
        digest = xxhash.xxh3_128_digest
        for b in slices(batches, 64):
            out, counts, first = [], [], []
            for s, body in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                k = len(body) - length + 1
                out += [digest(body[i : i + length]) for i in range(k)]
                first += range(s, s + k)
                counts.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(1).take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(first, pa.int64())], names=["d", "doc", "s"])

    # an anchor with very many different blocks: the same question for each of its strings, by counts
    many = segments.join(crowded, "anchor", "left_semi").select("anchor", "doc", "first", "body").mapInArrow(windows, f"d binary, doc {kind}, s bigint")
    twice = many.groupBy("d").agg(F.count("*").alias("n"), F.min(F.struct("doc", "s")).alias("at")).where("n > 1")
    again = many.join(twice, "d")
    if first_only:
        again = again.where(~(F.col("doc").eqNullSafe(F.col("at.doc")) & (F.col("s") == F.col("at.s"))))
    again = again.select("doc", "s", (F.col("s") + length).alias("e"))
    return whole.unionByName(by_order).unionByName(again)


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of consecutive numbers."""
    if not len(hit):
        return []
    cut = np.nonzero(np.diff(hit) > 1)[0]
    return list(zip(hit[np.concatenate([[0], cut + 1])].tolist(), hit[np.concatenate([cut, [len(hit) - 1]])].tolist(), strict=True))


def merged(found: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if e > n:
            continue
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, keep: str = "first", with_bytes: bool = False) -> DataFrame:
    """Remove repeated strings of ``length`` bytes, judged on the input; matches never cross documents.

    keep="first": later copies go, the first by id and place stays; keep="none": every
    copy goes. Columns: id, n_bytes, n_removed, n_spans (maximal runs of removed bytes),
    kept_sha256, and kept (the remaining bytes) if ``with_bytes``. Texts count as
    their UTF-8 bytes, nulls as empty. With keep="none" repeated rows repeat each
    other. Rows that share an id are documents of their own; with keep="first" rows that also
    share the text are taken for one. Other columns are ignored.
    """
    if keep not in ("first", "none") or not 0 < anchor <= length:
        raise ValueError("keep is first or none, an anchor is no longer than the string")
    scratch = Scratch(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    flat = docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_or_empty(text_col)).alias("t")).alias("id"), text_or_empty(text_col).alias("__text"))
    found = spans(scratch, flat, "id", "__text", length, anchor, keep)
    found = found.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set(F.struct("s", "e")).alias("found"))
    both = flat.join(found, F.col("id").eqNullSafe(F.col("__doc")), "left").select(F.col("id.i").alias("id"), "__text", "found")
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes

    def apply(batches):
        for b in slices(batches, 128):
            rows = []
            for text, got in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode()
                gone = merged([(x["s"], x["e"]) for x in got or ()], len(data))
                kept = cut_out(data, gone)
                rows.append([len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()] + [kept] * with_bytes)
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_bytes
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return both.mapInArrow(apply, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_bytes).withColumnRenamed("id", id_col)
