"""Substring dedup by content-defined chunking.

A gear rolling hash over the UTF-8 bytes sets chunk borders where its masked bits
are all zero, so borders depend on the bytes just before them and an insertion
moves only the borders next to it. Chunks that share a digest with an earlier one
are removed where they form a long enough run; the first copy stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join, slices, text_or_empty

#: Least, typical (a power of two, added to the least) and greatest bytes of a chunk; bytes a removed run has at least.
LEAST, TYPICAL, GREATEST, RUN = 16, 32, 256, 64
WINDOW = 16


def gear_table() -> np.ndarray:
    """A pseudo-random word for each byte value, from the digest of the value."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "big") for i in range(256)], np.uint32)


GEAR = gear_table()


def cuts(data: bytes, least: int = LEAST, typical: int = TYPICAL, greatest: int = GREATEST) -> list[int]:
    """Ends of the chunks; the last is the length. A chunk never ends inside a character."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h = GEAR[b]
    # the low 16 bits of the gear hash, whose older bytes are shifted out: sums over 2, 4, 8 and 16 bytes
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    mask = np.uint32((typical - 1) << (WINDOW - typical.bit_length() + 1))
    starts = (b & 0xC0) != 0x80
    found = np.nonzero(((h[:-1] & mask) == 0) & starts[1:])[0] + 1
    out, last = [], 0
    for c in [*found.tolist(), n]:
        while c - last > greatest:
            last += greatest
            while not starts[last]:
                last -= 1
            out.append(last)
        if c - last >= least or c == n:
            out.append(c)
            last = c
    return out if out[-1:] == [n] else [*out, n]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunk_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a chunk: digest, id, pos (number of the chunk in its text)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in slices(batches, 128):
            out, counts = [], []
            for text in b.column(1).to_pylist():
                data = text.encode()
                ends = cuts(data)
                out += [digest(data[s:e]) for s, e in zip([0, *ends], ends, strict=False)]
                counts.append(len(ends))
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            pos = np.concatenate([np.arange(c, dtype=np.int32) for c in counts]) if counts else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), ids, pa.array(pos)], names=["digest", "id", "pos"])

    return docs.select(id_col, text_or_empty(text_col).alias("__text")).mapInArrow(run, f"digest binary, id {kind}, pos int")


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """Remove runs of chunks that repeat earlier ones, across and within documents.

    Earlier: by id, then hash of the text, then place in it. A run of repeated chunks goes if
    it has ``run`` bytes at least (or is the whole text); shorter ones stay, as a few
    words recur by chance. Columns: id, n_bytes, n_removed, n_spans, kept_sha256 (of the
    remaining bytes), text (the remaining text). Nulls count as empty texts; empty texts
    have no chunks. Rows that share an id are documents of their own; rows that also
    share the text are taken for one, and the same chunks go in each. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    flat = docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_or_empty(text_col)).alias("t")).alias("id"), text_or_empty(text_col).alias("__text"))
    chunks = scratch.store(chunk_table(flat, id_col="id", text_col="__text"), "chunks")
    # counted with partial sums first, so a chunk in very many documents is a row a task
    twice = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first")).where("n > 1")
    later = hot_join(scratch, chunks, twice, ["digest"], "n", "twice").where(~F.struct("id", "pos").eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("id").alias("__id")).agg(F.collect_set("pos").alias("gone"))
    gone = scratch.store(gone, "gone")
    scratch.drop_named("chunks", "twice")
    kind = dict(docs.dtypes)[id_col]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]

    def apply(batches):
        for b in slices(batches, 128):
            rows = []
            for text, pos in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode()
                spans: list[tuple[int, int]] = []
                if pos:
                    ends = cuts(data)
                    for p in sorted(pos):
                        if p < len(ends):
                            s, e = ends[p - 1] if p else 0, ends[p]
                            if spans and spans[-1][1] == s:
                                spans[-1] = spans[-1][0], e
                            else:
                                spans.append((s, e))
                    spans = [(s, e) for s, e in spans if e - s >= min(run, len(data))]
                kept = cut_out(data, spans)
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=names)

    both = flat.join(gone, flat["id"].eqNullSafe(gone["__id"]), "left").select(F.col("id.i").alias("id"), "__text", "gone")
    return both.mapInArrow(apply, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string").withColumnRenamed("id", id_col)
