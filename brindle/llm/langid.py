"""Language ID by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed character n-grams (1 to 3
characters within words). Each language has several centroids, found by
spherical k-means over its training vectors. A text gets the language of the
centroid with the greatest cosine; one that is farther from it than nearly all
training texts of that centroid is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX, U64, remember, slices, trim

UNKNOWN = "und"
#: Rows of the training sample at most, for all languages together; hashed dimensions; centroids a language.
SAMPLE, DIMENSIONS, CENTROIDS = 4_000, 1 << 12, 4
#: A text is rejected if its cosine is below this share of the cosine that MARGIN of its language's training texts reach.
SLACK, MARGIN = 0.5, 0.995
#: A text of fewer n-grams has its bound lowered in proportion, as few n-grams say little.
ENOUGH = 100
#: Characters worked on at once; counts add up, so the whole text is read whatever its length.
CHUNK = 1 << 18


def counts(text: str, dims: int) -> np.ndarray:
    """Counts of hashed n-grams of the whole text. Letters keep their identity, any other character is a break."""
    out = np.zeros(dims, np.float64)
    text = text.lower()
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[max(0, at - 2) : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        new = 2 if at else 0
        # breaks in ASCII are told by a table; beyond it letters start at 0xAA, and what isn't one is rare enough to do no harm
        word = ((c >= 97) & (c <= 122)) | (c >= 0xAA)
        x = np.where(word, c, 32).astype(U64)
        one = x * U64(0x9E3779B97F4A7C15)
        two = one[:-1] * MIX + x[1:] if len(x) > 1 else one[:0]
        three = two[:-1] * U64(0xC2B2AE3D27D4EB4F) + x[2:] if len(x) > 2 else one[:0]
        shift = U64(64 - dims.bit_length() + 1)
        for h, k, salt, keep in ((one, 1, 1, word), (two, 2, 2, word[:-1] | word[1:]), (three, 3, 3, word[1:-1])):
            first = max(0, new - k + 1)
            h = ((h + U64(salt)) * MIX)[first:][keep[first:]] if len(h) else h
            if len(h):
                out += np.bincount((h >> shift).astype(np.int64), minlength=dims)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vector(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n) * idf
    return x / (np.sqrt(x @ x) or 1.0)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # one a row, of length 1
    lang: list[str]  # of each centroid
    least: np.ndarray  # cosine below which a text of the centroid with ENOUGH n-grams is rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected). No letters: unknown, 0, rejected."""
        if not text or not len(self.lang) or not has_letter(text):
            return UNKNOWN, 0.0, True
        n = counts(text, len(self.idf))
        near = self.centroids @ vector(n, self.idf)
        best = int(np.argmax(near))
        score = float(min(1.0, max(0.0, near[best])))
        return self.lang[best], round(score, 9), score < self.least[best] * min(1.0, n.sum() / ENOUGH)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other but not far from the mean, so it needs no chance."""
    to_mean = x @ x.mean(0)
    picked = [int(np.argmax(to_mean))]
    near = np.where(to_mean >= np.quantile(to_mean, 0.2), x @ x[picked[0]], np.inf)
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        new = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def training_rows(docs: DataFrame, train: Column, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """(l, h, t): at most ``sample`` different labelled rows, as many of each language if it has them, those with the least hash of id and text.

    Of more languages than ``sample`` the most frequent take part. Repeated rows count once.
    """
    known = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    sizes = known.groupBy("l").count().orderBy(F.desc("count"), "l").limit(sample).collect()
    each = sample // max(1, len(sizes))
    # rows with a hash below the share that gives about twice the wanted number, then exactly the least ones
    shares = [(r["l"], int(min(1.0, (2.0 * each + 20.0) / r["count"]) * ((1 << 62) - 1))) for r in sizes]
    bounds = docs.sparkSession.createDataFrame(shares, "l string, bound bigint")
    few = known.join(F.broadcast(bounds), "l").where(F.col("h").bitwiseAND((1 << 62) - 1) <= F.col("bound"))
    few = few.groupBy("l", "h").agg(F.first("t").alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    return few.withColumn("r", rank).where(F.col("r") <= each).select("l", "h", "t")


def fit(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, dims: int = DIMENSIONS, centroids: int = CENTROIDS) -> Model:
    """Fit on a bounded sample of the rows where ``train`` holds and text and language are known.

    The sample (``training_rows``: at most ``sample`` rows in all, whatever ids or texts
    repeat) is read as sparse vectors; the rest of the fit is arithmetic on them.
    """

    def sparse(batches):
        for b in slices(batches, 64):
            at, value = [], []
            for text in b.column(2).to_pylist():
                x = counts(text, dims) if has_letter(text) else np.zeros(dims)
                j = np.nonzero(x)[0]
                at.append(j.astype(np.int16 if dims <= 1 << 15 else np.int32))
                value.append(x[j].astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(small)), pa.array(value, pa.list_(pa.float32()))], names=["l", "h", "at", "value"])

    small, name = (pa.int16(), "smallint") if dims <= 1 << 15 else (pa.int32(), "int")
    picked = training_rows(docs, train, id_col, text_col, lang_col, sample)
    got = picked.mapInArrow(sparse, f"l string, h bigint, at array<{name}>, value array<float>").toArrow()
    order = np.argsort(got["h"].to_numpy(), kind="stable")
    langs = got["l"].to_pylist()
    rows: dict[str, list[int]] = {}
    for i in order:
        rows.setdefault(langs[i], []).append(int(i))
    at, value = got["at"].combine_chunks(), got["value"].combine_chunks()

    def dense(own: list[int]) -> np.ndarray:
        x = np.zeros((len(own), dims), np.float32)
        for j, i in enumerate(own):
            x[j, at[i].values.to_numpy()] = value[i].values.to_numpy()
        return x[x.any(1)]

    n, df = 0, np.zeros(dims)
    for own in rows.values():
        x = dense(own)
        n, df = n + len(x), df + (x > 0).sum(0)
    idf = (np.log((1.0 + n) / (1.0 + df)) + 1.0).astype(np.float32)
    out, names, least = [], [], []
    for lang, own in sorted(rows.items()):
        x = dense(own)
        if not len(x):
            continue
        np.log1p(x, out=x)
        x *= idf
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = kmeans(x, centroids)
        best = np.sort((x @ c.T).max(1))
        for j in range(len(c)):
            out.append(c[j].astype(np.float64))
            names.append(lang)
            least.append(SLACK * float(best[int((1 - MARGIN) * len(best))]))
        del x
    trim()
    return Model(idf.astype(np.float64), np.stack(out) if out else np.zeros((0, dims)), names, np.array(least))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns: id, those of ``keep``, lang_pred, score (cosine, 0 to 1), rejected.

    A text that is null or without letters is ``und`` with score 0 and rejected.
    Rows pass one by one: repeated rows repeat; other columns are ignored.
    """
    kinds = dict(docs.select(id_col, *keep).dtypes)

    def run(batches):
        remember("langid")
        for b in slices(batches):
            got = [model.predict(t) for t in b.column(len(kinds)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kinds)], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([bool(x[2]) for x in got], pa.bool_())], names=[*kinds, "lang_pred", "score", "rejected"])

    schema = ", ".join([*(f"`{k}` {v}" for k, v in kinds.items()), "lang_pred string, score double, rejected boolean"])
    return docs.select(id_col, *keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of the documents that nothing is learned from; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))) % 5 == 0


def reject(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents without those that the language ID rejects; the columns stay, ``lang_col`` is filled where it is null."""
    model = fit(docs, ~held_out(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col)
    cols = docs.columns
    flat = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"))
    at = [c.lower() for c in cols].index(text_col.lower())  # the text is read out of the row, so that it passes once

    def run(batches):
        remember("langid")
        for b in slices(batches):
            got = [model.predict(t) for t in b.column(0).field(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([bool(x[2]) for x in got], pa.bool_())], names=["__row", "__lang", "__out"])

    kind = flat.schema["__row"].dataType.simpleString()
    kept = flat.mapInArrow(run, f"__row {kind}, __lang string, __out boolean").where(~F.col("__out"))
    return kept.select(*[F.coalesce(F.col(f"__row.`{c}`"), F.col("__lang")).alias(c) if c == lang_col else F.col(f"__row.`{c}`").alias(c) for c in cols])
