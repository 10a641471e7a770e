"""Fuzzy line dedup by MinHash.

Lines are compared as sets of character shingles of their normal form (lower
case, single blanks). Signatures are cut into bands with high recall; lines that
share a band are verified by exact Jaccard similarity; distributed union-find
joins what is similar, and one line of each component stays.

Shingles of 4 characters let short lines bear an edit, but long unlike lines share
many of them; those of 8 tell long lines apart. So lines are compared by 4-shingles
if their different words have up to 200 characters, by 8-shingles if they have over
160, and by both in between. Lines on either side of both bounds are too unlike in
what they say to be copies, and aren't compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, U64, Scratch, components, hot_join, mix64, remember, runs_hash, slices, sorted_set, text_or_empty
from .pairs import similar_pairs

#: Least similarity. Characters a shingle, hashes a band and bands of lines with few shingles, and of lines with many.
#: A pair at 0.8 is missed with probability 0.004 and 0.002, one at 0.9 with 0.000001 or less.
THRESHOLD, FEW, MANY = 0.8, (4, 6, 18), (8, 4, 12)
#: Lines whose different words have more characters than this, and up to a quarter more, are of both kinds; characters of a word that count.
BORDER, WORD = 160, 32
#: Bytes of a line's sketch, from its first hashes.
SKETCH = 48
#: Turns in which the keys are dealt out, so that the disk holds a part of them twice at a time.
TURNS = 2
#: Keys a task packs at once; parts by which they are dealt out, for each partition of a shuffle.
PACK, PARTS = 1 << 18, 4
#: Up to so many wanted lines are broadcast to where the texts are read (16 bytes each); more are shuffled.
BROADCAST = 300_000
#: Lines a task remembers, so as not to give the keys of a copy again.
SEEN = 200_000


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shingles(line: str, k: int) -> np.ndarray:
    """The set of hashed character shingles of a normal form; a shorter line is one shingle."""
    c = code_points(line).astype(U64)
    return sorted_set(runs_hash(c, min(k, len(c)))) if len(c) else np.empty(0, U64)


def kinds(words: list[str]) -> tuple[int, ...]:
    """Characters of the shingles by which a line of these words is compared."""
    n = 0
    for own in (words[:45], words) if len(words) > 45 else (words,):  # the start tells nearly always
        different = set(own)
        n = len(" ".join(different)) + 1 if max(map(len, different)) <= WORD else sum([min(len(w), WORD) + 1 for w in different])
        if n > BORDER * 5 // 4:
            return (MANY[0],)
    return (FEW[0],) if n <= BORDER else (FEW[0], MANY[0])


def multipliers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return (mix64(np.arange(1, n + 1, dtype=U64) * MIX + U64(k)) | U64(1)).astype(np.uint32)[:, None], mix64(np.arange(1001, n + 1001, dtype=U64) * MIX + U64(k)).astype(np.uint32)[:, None]


#: Multipliers and summands of the hashes by shingle length.
_HASHES = {k: multipliers(k, rows * bands) for k, rows, bands in (FEW, MANY)}


def hashed(lines: list[str], k: int) -> list[np.ndarray]:
    """The hashed shingles of several lines at once, in the order of the text."""
    flat = runs_hash(code_points("\n".join([x for x in lines if len(x) >= k])).astype(U64), k)
    out, s = [], 0
    for x in lines:
        if len(x) >= k:
            out.append(flat[s : s + len(x) - k + 1])
            s += len(x) + 1
        else:
            out.append(shingles(x, k))
    return out


def shingle_sets(items: list[int], lines: list[str]) -> list[np.ndarray]:
    """The shingle sets of several items, each by the length of shingle that its last bit tells."""
    out: list = [None] * len(items)
    for k in (FEW[0], MANY[0]):
        at = [i for i, item in enumerate(items) if item & 1 == (k == MANY[0])]
        for i, x in zip(at, hashed([lines[i] for i in at], k), strict=True):
            out[i] = sorted_set(x)
    return out


def shingle_set(item: int, line: str) -> np.ndarray:
    return shingles(line, (FEW, MANY)[item & 1][0])


def band_keys(lines: list[str], how: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of several lines at once, and their sketches, a row a line; lines aren't empty."""
    k, rows, bands = how
    odd, add = _HASHES[k]
    parts = hashed(lines, k)
    edges = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]])
    words = (np.concatenate(parts) >> U64(32)).astype(np.uint32)
    sig = np.empty((rows * bands, len(lines)), np.uint32)
    work = np.empty((6, len(words)), np.uint32)
    for i in range(0, rows * bands, 6):
        np.multiply(words, odd[i : i + 6], out=work)
        np.add(work, add[i : i + 6], out=work)
        np.minimum.reduceat(work, edges, axis=1, out=sig[i : i + 6])
    # all bands at once, so that short batches cost few calls
    keys = (np.arange(1, bands + 1, dtype=U64) * MIX + U64(k))[:, None]
    for row in sig.reshape(bands, rows, len(lines)).swapaxes(0, 1):
        keys = mix64(keys ^ row.astype(U64))
    return np.ascontiguousarray(keys.T), (sig[:SKETCH] >> np.uint32(4)).astype(np.uint8).T


def hashes(digests: list[bytes]) -> np.ndarray:
    """63 bits of each digest and a last bit of 0, which tells the kind."""
    return np.frombuffer(b"".join(digests), np.int64)[::2] & np.int64(-2)


def packed(keys: list[np.ndarray], ids: list[np.ndarray], parts: int) -> tuple[np.ndarray, pa.Array]:
    """Numbers of parts, and the (key, id) of each as 64-bit words in one binary value."""
    pairs = np.empty((sum(x.size for x in keys), 2), np.int64)
    np.concatenate([x.reshape(-1) for x in keys], out=pairs[:, 0])
    np.concatenate([np.repeat(i, x.shape[1]) for x, i in zip(keys, ids, strict=True)], out=pairs[:, 1])
    of = ((pairs[:, 0].view(U64) >> U64(32)) % U64(parts)).astype(np.uint16)
    pairs = pairs[np.argsort(of, kind="stable")]
    sizes = np.bincount(of, minlength=parts)
    own = np.nonzero(sizes)[0]
    ends = np.concatenate([[0], np.cumsum(sizes[own] * 16)]).astype(np.int32)
    return own, pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])


def shared_keys(pairs: np.ndarray) -> list[np.ndarray]:
    """Of rows (key, id), those of keys with several ids, each once: key, id, number of the key's ids, one of them for all."""
    keys = np.sort(pairs[:, 0])
    twice = sorted_set(keys[1:][keys[1:] == keys[:-1]])
    if not len(twice):
        return [np.empty(0, np.int64)] * 4
    at = np.minimum(np.searchsorted(twice, pairs[:, 0]), len(twice) - 1)
    pairs = pairs[twice[at] == pairs[:, 0]]
    # copies of a line, from several tasks, are next to each other and fall together; so is what shares a key
    key, item = pairs[np.lexsort((mix64(pairs[:, 1].view(U64) ^ pairs[:, 0].view(U64)), pairs[:, 0]))].T
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
    key, item = key[new], item[new]
    starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    m = np.diff(np.append(starts, len(key)))
    several = np.repeat(m > 1, m)
    return [x[several] for x in (key, item, np.repeat(m, m), np.repeat(item[starts], m))]


def line_table(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """One row a line that isn't blank and kind: line (digest of its normal form), id (its hash, in the last bit the kind), doc, pos, sketch.

    Id and sketch are empty where the task had the line a while ago; pos is null in the
    second row of a line of two kinds. Other rows hold the keys of many lines: part, pairs.
    """
    id_kind = dict(docs.dtypes)[id_col]
    names = ["line", "id", "doc", "pos", "sketch", "part", "pairs"]
    types = [pa.binary(), pa.int64(), None, pa.int32(), pa.binary(), pa.int32(), pa.binary()]  # that of doc is the batches'

    def rows(n: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)

    def run(batches):
        remember("lines")
        with np.errstate(over="ignore"):
            seen: set[bytes] = set()
            held: tuple[list, list] = [], []
            size_held = 0

            def pack():
                own, pairs = packed(*held, parts)
                held[0].clear()
                held[1].clear()
                return rows(len(own), part=pa.array(own, pa.int32()), pairs=pairs)

            for b in slices(batches, 128):
                types[2] = b.column(0).type
                if len(seen) > SEEN:
                    seen.clear()
                # by kind: digests, documents, places, texts
                got: dict[int, list[tuple]] = {0: [], FEW[0]: [], MANY[0]: []}
                for at, text in enumerate(b.column(1).to_pylist()):
                    for i, line in enumerate(text.lower().split("\n")):
                        if words := line.split():
                            x = " ".join(words)
                            d = xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass"))
                            if d in seen:
                                own: tuple = (0,)
                            else:
                                seen.add(d)
                                own = (FEW[0],) if len(x) < BORDER else kinds(words)
                            for k in own:
                                got[k].append((d, at, i if k == own[0] else None, x))
                for how in ((0, 0, 0), FEW, MANY):
                    n = len(got[how[0]])
                    if not n:
                        continue
                    digests, docs_at, pos, texts = zip(*got[how[0]], strict=True)
                    keys, sketches = [], []
                    begin = size = 0
                    for i, x in enumerate(texts if how[0] else ()):  # about 64 KB at a time stay in the cache
                        size += len(x)
                        if size > 1 << 14 or i + 1 == n:
                            k, sketch = band_keys(texts[begin : i + 1], how)
                            keys.append(k)
                            sketches.append(sketch)
                            begin, size = i + 1, 0
                    cols = {"line": pa.array(digests, pa.binary()), "doc": b.column(0).take(pa.array(docs_at, pa.int64())), "pos": pa.array(pos, pa.int32())}
                    if sketches:
                        data = np.ascontiguousarray(np.concatenate(sketches))
                        cols["sketch"] = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, data.size + 1, SKETCH, dtype=np.int32)), pa.py_buffer(data)])
                        ids = hashes(digests) | np.int64(how[0] == MANY[0])
                        cols["id"] = pa.array(ids)
                        held[0].append(np.concatenate(keys).view(np.int64))
                        held[1].append(ids)
                        size_held += n * how[2]
                    yield rows(n, **cols)
                if size_held >= PACK:
                    yield pack()
                    size_held = 0
            if size_held:
                yield pack()

    return docs.select(id_col, text_or_empty(text_col).alias("__text")).mapInArrow(run, f"line binary, id bigint, doc {id_kind}, pos int, sketch binary, part int, pairs binary")


def several(batches):
    """Rows (part, pairs) in the order of the parts: the shared keys of each part."""
    def found(held: list[bytes]) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            cols = shared_keys(np.frombuffer(b"".join(held), np.int64).reshape(-1, 2))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "id", "m", "pivot"])

    remember("lines")
    held: list[bytes] = []
    now = None
    for b in batches:
        for part, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if part != now and held:
                yield found(held)
                held = []
            now = part
            held.append(pairs)
    if held:
        yield found(held)


def later_lines(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(doc, gone): numbers of the lines of each document of which the component has an earlier one."""
    parts = min(PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << 16) - 1)
    table = scratch.store(line_table(docs, id_col, text_col, parts), "lines", unlike=("line", "id", "sketch", "pairs"))
    keyed = None
    for turn in range(TURNS):
        # an item is a line in one of its kinds; a key counts if two different lines have it
        rows = table.where(F.col("part") % TURNS == turn).select("part", "pairs").repartition("part").sortWithinPartitions("part")
        part = scratch.store(rows.mapInArrow(several, "key bigint, id bigint, m bigint, pivot bigint"), f"keyed-{turn}")
        keyed = part if keyed is None else keyed.unionByName(part)
    # sketches rule out unlike lines before their texts are read; sizes aren't known yet and count as equal
    light = table.where("sketch is not null").select("id", "sketch").join(keyed.select("id").distinct(), "id", "left_semi")
    light = scratch.store(light.groupBy("id").agg(F.lit(1).cast("bigint").alias("n"), F.first("sketch").alias("sketch")), "light")
    places = scratch.store(table.where("pos is not null").select("line", "doc", "pos"), "places", unlike=("line",))
    scratch.drop(table)

    def bodies(ids: DataFrame) -> DataFrame:
        ids = scratch.store(ids.select("id", F.col("id").bitwiseAND(F.lit(-2).cast("bigint")).alias("hash")), "wanted")
        wanted = ids.select("hash").distinct()
        wanted = F.broadcast(wanted) if ids.count() <= BROADCAST else wanted

        def texts(batches):
            for b in slices(batches, 128):
                seen = {}
                for text in b.column(0).to_pylist():
                    for line in text.lower().split("\n"):
                        if x := " ".join(line.split()):
                            seen.setdefault(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")), x)
                digests = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array(hashes(digests)), pa.array(digests, pa.binary()), pa.array(list(seen.values()), pa.string())], names=["hash", "line", "body"])

        lines = docs.select(text_or_empty(text_col).alias("__text")).mapInArrow(texts, "hash bigint, line binary, body string")
        # of unlike lines of one hash, the first by digest stands for it, and only that is an item
        one = lines.join(wanted, "hash", "left_semi").groupBy("hash").agg(F.min(F.struct("line", "body")).alias("own"))
        return scratch.store(one.join(ids, "hash").select("id", F.lit(1).cast("bigint").alias("copies"), "own.line", "own.body"), "bodies")

    body = None

    def kept_bodies(ids: DataFrame) -> DataFrame:
        nonlocal body
        body = bodies(ids)
        return body.select("id", "copies", "body")

    _, edges = similar_pairs(scratch, keyed, light, kept_bodies, shingle_set, threshold, "lines", links=False, to_sets=shingle_sets)
    even = F.lit(-2).cast("bigint")
    roots = components(scratch, edges.select(F.col("a").bitwiseAND(even).alias("a"), F.col("b").bitwiseAND(even).alias("b")))
    digests = body.select(F.col("id").bitwiseAND(even).alias("node"), "line").distinct()
    roots = roots.join(digests, "node").select(F.col("line").alias("own"), F.col("root").alias("node")).join(digests, "node").select(F.col("own").alias("node"), F.col("line").alias("root"))
    roots = scratch.store(roots, "roots")
    scratch.drop_named(*[f"keyed-{turn}" for turn in range(TURNS)], "light", "wanted", "bodies", "lines-links", "lines-pivot-edges")
    # only places of lines that are common or in a component go on; a line with one place and no component stays, whatever else there is
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())  # roots aren't nodes of their own
    by_line = places.groupBy("line").agg(F.count("*").alias("n"))
    by_line = by_line.join(roots, F.col("line") == F.col("node"), "left").where("n > 1 or node is not null").select("line", F.coalesce("root", "line").alias("part"), "n")
    busy = scratch.store(hot_join(scratch, places, by_line, ["line"], "n", "by-line").select("part", "doc", "pos"), "busy")
    scratch.drop(places)
    scratch.drop_named("by-line", "roots")
    parts = busy.groupBy("part").agg(F.count("*").alias("total"), F.min(F.struct("doc", "pos")).alias("first")).where("total > 1")
    gone = hot_join(scratch, busy, parts, ["part"], "total", "parts").where(~F.struct("doc", "pos").eqNullSafe(F.col("first")))
    return gone.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("pos").alias("gone"))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with two more columns: __kept (text without the lines that are gone) and __gone (their number)."""
    both = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__doc")), "left").drop("__doc")
    # numbers of the lines that stay, by hash sets; then each is looked up once, so a text of very many lines costs its length
    lines = F.transform(F.array(F.split(F.col(text_col), "\n", -1)), lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("gone")), lambda i: F.get(own, i)))
    kept = F.array_join(F.get(lines, F.lit(0)), "\n")
    return both.withColumn("__kept", F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(kept)).withColumn("__gone", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint")).drop("gone")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Keep one line, the first by id and place, of each component of similar lines.

    Columns: id, n_lines, n_removed, text (what stays). Blank lines aren't compared
    and stay. A null text stays null and has no lines. Rows that share an id are documents
    of their own, the first by a hash of the text; rows that also share the text are taken
    for one, and the same lines go in each. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    flat = docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_or_empty(text_col)).alias("t")).alias("__id"), F.col(text_col).alias("__text"))
    gone = later_lines(scratch, flat, "__id", "__text", threshold)
    out = without(flat, gone, "__id", "__text")
    breaks = F.octet_length("__text") - F.octet_length(F.replace(F.col("__text"), F.lit("\n"), F.lit("")))
    lines = F.coalesce(breaks + 1, F.lit(0)).cast("bigint")
    return out.select(F.col("__id.i").alias(id_col), lines.alias("n_lines"), F.col("__gone").alias("n_removed"), F.col("__kept").alias("text"))


def drop_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the later lines taken out of their texts; a document that had lines and has none left goes.

    The columns stay; ``count_col``, if there is one, is the new number of characters.
    """
    scratch = Scratch(docs.sparkSession)
    cols = docs.columns
    flat = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.struct(F.col(id_col).alias("i"), F.xxhash64(text_or_empty(text_col)).alias("t")).alias("__id"), F.col(text_col).alias("__text"))
    gone = later_lines(scratch, flat, "__id", "__text", threshold)
    out = without(flat, gone, "__id", "__text").where((F.col("__gone") == 0) | (F.trim(F.regexp_replace("__kept", r"\s+", "")) != ""))
    new = {text_col: F.col("__kept"), count_col: F.when(F.col("__gone") == 0, F.col(f"__row.`{count_col}`")).otherwise(F.length("__kept")) if count_col in cols else None}
    kinds = dict(docs.dtypes)
    return out.select(*[new[c].cast(kinds[c]).alias(c) if new.get(c) is not None else F.col(f"__row.`{c}`").alias(c) for c in cols])
