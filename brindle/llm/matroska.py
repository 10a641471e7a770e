"""Matroska files as a column: writer, reader and packet tables.

The writer lays samples out as lossless 8-bit PCM in one track; frames are
laced into simple blocks, blocks into clusters, and cues index the clusters.
The reader parses any file of variable-length EBML elements, also with unknown
sizes, block groups and all four kinds of lacing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_or_empty

# Element ids of the EBML and Matroska specifications (RFC 8794, RFC 9559).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, VOID, CRC32 = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469, 0xEC, 0xBF
# What ends a cluster or segment of unknown size.
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}

#: Samples a frame, frames a block, blocks a cluster; a sample is a byte, 8000 a second.
FRAME, LACED, BLOCKS, RATE = 576, 8, 32, 8000


def size_bytes(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones in the value bits mean unknown, so they aren't used."""
    width = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced_block(track: int, offset: int, frames: list[bytes], lacing: str = "auto") -> bytes:
    """Body of a simple block. lacing: none, xiph, ebml, fixed, or auto (fixed where frames are equally long)."""
    if lacing == "auto":
        lacing = "none" if len(frames) == 1 else "fixed" if len({len(f) for f in frames}) == 1 else "ebml"
    head = size_bytes(track) + struct.pack(">hB", offset, 0x80 | {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}[lacing])
    if lacing == "none":
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == "xiph":
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
    elif lacing == "ebml":
        head += size_bytes(sizes[0]) if len(sizes) > 1 else b""
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            d = b - a
            w = next(w for w in range(1, 9) if abs(d) < (1 << (7 * w - 1)) - 1)
            head += size_bytes(d + (1 << (7 * w - 1)) - 1, w)
    return head + b"".join(frames)


def write(payload: bytes, *, frame: int = FRAME, laced: int = LACED, blocks: int = BLOCKS, rate: int = RATE, lacing: str = "auto") -> bytes:
    """A Matroska file that holds the payload as 8-bit samples. The same payload gives the same bytes."""
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    scale = 1_000_000_000 * frame // rate  # a tick is a frame
    info = element(INFO, number(TIMESTAMP_SCALE, scale) + element(MUXING_APP, b"brindle") + element(WRITING_APP, b"brindle") + element(DURATION, struct.pack(">d", -(-len(payload) // frame))))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    body = info + element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, at, step = [body], [], len(body), frame * laced * blocks
    for start in range(0, len(payload), step):
        tick = start // frame
        inner = [number(TIMESTAMP, tick)]
        for b in range(start, min(start + step, len(payload)), frame * laced):
            frames = [payload[i : min(i + frame, len(payload))] for i in range(b, min(b + frame * laced, len(payload)), frame)]
            inner.append(element(SIMPLE_BLOCK, laced_block(1, b // frame - tick, frames, lacing)))
        cues.append(element(CUE_POINT, number(CUE_TIME, tick) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(inner)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def varint(data: bytes, at: int, *, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, its width, whether it is the unknown size)."""
    first = data[at]
    if not first:
        raise ValueError("a number of more than 8 bytes")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("cut off")
    n = int.from_bytes(data[at : at + width], "big")
    value = n & ((1 << (7 * width)) - 1)
    return (n if keep_marker else value), width, value == (1 << (7 * width)) - 1


def elements(data: bytes, at: int, end: int, stops: frozenset | set = frozenset()):
    """(id, start of the element, start and end of its body). An unknown size lasts until ``stops`` or the end."""
    while at < end:
        ident, w, _ = varint(data, at, keep_marker=True)
        if ident in stops:
            return
        n, v, unknown = varint(data, at + w)
        body = at + w + v
        if unknown:
            last = body
            for _, _, _, last in elements(data, body, end, TOP_LEVEL if ident == CLUSTER else frozenset()):
                pass
            stop = last
        else:
            stop = body + n
        if stop > end:
            raise ValueError("an element goes beyond its parent")
        yield ident, at, body, stop
        at = stop


def unlace(data: bytes, body: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, time offset, flags, byte ranges of the frames) of a block."""
    track, w, _ = varint(data, body)
    offset, flags = struct.unpack_from(">hB", data, body + w)
    at, kind = body + w + 3, flags >> 1 & 3
    if not kind:
        return track, offset, flags, [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif kind == 3:
        if count > 1:
            n, w, _ = varint(data, at)
            sizes, at = [n], at + w
        for _ in range(count - 2):
            d, w, _ = varint(data, at)
            sizes.append(sizes[-1] + d - ((1 << (7 * w - 1)) - 1))
            at += w
    else:
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // count] * (count - 1)
    edges = [at]
    for n in sizes:
        edges.append(edges[-1] + n)
    if min(sizes, default=0) < 0 or edges[-1] > end:
        raise ValueError("frames go beyond their block")
    return track, offset, flags, list(zip(edges, [*edges[1:], end], strict=True))


def read(data: bytes) -> dict:
    """Parse a file: tracks, cues, and packets (track, timestamp in ticks, start, end, keyframe, cluster's place).

    The frames of a laced block share its timestamp. Raises ValueError for bytes
    that aren't a Matroska file.
    """
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    out = {"doc_type": None, "scale": 1_000_000, "tracks": [], "cues": [], "packets": [], "clusters": 0}
    try:
        for ident, _, a, b in elements(data, 0, len(data)):
            if ident == EBML:
                out["doc_type"] = next((bytes(data[c:d]).decode("ascii") for i, _, c, d in elements(data, a, b) if i == DOC_TYPE), None)
            elif ident == SEGMENT:
                for i, place, c, d in elements(data, a, b):
                    if i == INFO:
                        out["scale"] = next((uint(e, f) for j, _, e, f in elements(data, c, d) if j == TIMESTAMP_SCALE), out["scale"])
                    elif i == TRACKS:
                        for j, _, e, f in elements(data, c, d):
                            if j == TRACK_ENTRY:
                                track = {k: (g, h) for k, _, g, h in elements(data, e, f)}
                                out["tracks"].append({"number": uint(*track[TRACK_NUMBER]), "codec": bytes(data[slice(*track[CODEC_ID])]).decode("ascii") if CODEC_ID in track else None})
                    elif i == CLUSTER:
                        base, out["clusters"] = 0, out["clusters"] + 1
                        for j, _, e, f in elements(data, c, d, TOP_LEVEL):
                            blocks = [(j, e, f)] if j == SIMPLE_BLOCK else [(k, g, h) for k, _, g, h in elements(data, e, f) if k == BLOCK] if j == BLOCK_GROUP else []
                            if j == TIMESTAMP:
                                base = uint(e, f)
                            for k, g, h in blocks:
                                number_, offset, flags, frames = unlace(data, g, h)
                                out["packets"] += [(number_, base + offset, s, t, k == SIMPLE_BLOCK and flags >= 128, place - a) for s, t in frames]
                    elif i == CUES:
                        for j, _, e, f in elements(data, c, d):
                            if j == CUE_POINT:
                                point = {k: (g, h) for k, _, g, h in elements(data, e, f)}
                                where = {k: uint(g, h) for k, _, g, h in elements(data, *point[CUE_TRACK_POSITIONS])}
                                out["cues"].append((uint(*point[CUE_TIME]), where.get(CUE_TRACK), where.get(CUE_CLUSTER_POSITION)))
    except (IndexError, KeyError, struct.error, UnicodeDecodeError) as e:
        raise ValueError(f"not a Matroska file: {e}") from e
    if out["doc_type"] is None:
        raise ValueError("not a Matroska file: no EBML head")
    return out


def payload_of(data: bytes, parsed: dict, track: int = 1) -> bytes:
    return b"".join([data[s:e] for n, _, s, e, _, _ in parsed["packets"] if n == track])


def features(samples: bytes, parsed: dict) -> str:
    """Packets, clusters, cues, then the samples' mean, deviation and mean step in thousandths, and 8 counts by value."""
    x = np.frombuffer(samples, np.uint8)
    steps = np.abs(np.diff(x.astype(np.int16)))
    counts = np.bincount(x >> 5, minlength=8)
    mean = int(x.sum(dtype=np.int64)) * 1000 // max(1, len(x))
    square = int((x.astype(np.int64) ** 2).sum()) * 1_000_000 // max(1, len(x))
    return ",".join(map(str, [len(parsed["packets"]), parsed["clusters"], len(parsed["cues"]), mean, int(max(0, square - mean * mean) ** 0.5), int(steps.sum(dtype=np.int64)) * 1000 // max(1, len(steps)), *counts.tolist()]))


def pad(data: bytes, unit: int = FRAME) -> bytes:
    return data + b"\xff" * (-len(data) % unit or (0 if data else unit))


def packet_table(files: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row a packet of each file: id, track, timestamp_ns, start, end (byte range), keyframe, cluster.

    A null file gives no rows; bytes that aren't a Matroska file give one row with
    only the error filled. Repeated files give their packets again.
    """
    kind = dict(files.dtypes)[id_col]

    def run(batches):
        for b in slices(batches, 64):
            out = {k: [] for k in ("id", "track", "timestamp_ns", "start", "end", "keyframe", "cluster", "error")}
            for ident, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    parsed = read(data)
                    rows = [(ident, n, t * parsed["scale"], s, e, k, c, None) for n, t, s, e, k, c in parsed["packets"]]
                except ValueError as e:
                    rows = [(ident, *[None] * 6, str(e))]
                for k, v in zip(out, zip(*rows, strict=True), strict=False):
                    out[k] += v
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()), strict=True)], names=list(out))

    return files.select(id_col, media_col).mapInArrow(run, f"id {kind}, track bigint, timestamp_ns bigint, start bigint, end bigint, keyframe boolean, cluster bigint, error string").withColumnRenamed("id", id_col)


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", media: bool = False) -> DataFrame:
    """Store each text's UTF-8 bytes, padded with 255 to a positive multiple of 576, as a Matroska file and read it back.

    Columns: id, n_bytes (unpadded), payload_bytes, payload_sha256, tail_crc32 (last 32
    bytes) - all from the bytes read back -, media_bytes, media_sha256, feature, n_packets,
    and the file itself if ``media``. A null or empty text is one frame of padding. Equal
    texts have equal values; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets"] + ["media"] * media
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * media

    def run(batches):
        for b in slices(batches, 64):
            rows = []
            for text in b.column(1).to_pylist():
                data = text.encode()
                file = write(pad(data))
                parsed = read(file)
                back = payload_of(file, parsed)
                rows.append([len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), features(back, parsed), len(parsed["packets"])] + [file] * media)
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_packets bigint" + ", media binary" * media
    return docs.select(id_col, text_or_empty(text_col).alias("__text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
