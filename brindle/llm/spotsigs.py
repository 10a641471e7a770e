"""SpotSigs document fingerprints, in DataFrame functions only.

Each occurrence of a common word is an anchor; the content words that follow it
form a chain, and the set of hashed chains is the document's fingerprint. Two
fingerprints are compared by Jaccard similarity; for a join they are partitioned
by the size of the set, so that only sizes within the threshold's ratio meet.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

# Common words of English, French, German and Spanish.
COMMON = {
    "en": "the of and to in is that for with as on by are this be at or an it from was were has have had not but they he she you we his her its which will would there their been one all so if no who when can more out up into than them then some about only other over also after".split(),
    "fr": "le la les de des du et en un une que qui dans pour par sur au aux est pas ce se il elle ne plus avec son sa ses ou mais comme nous vous ils on leur cette".split(),
    "de": "der die das und in zu den von mit ist des im dem nicht ein eine auf für als sich auch es an er so dass aus wie bei oder nach sind noch wird einer einem einen am zum zur".split(),
    "es": "el la los las de del y en que un una por con para se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde".split(),
}
WORDS = tuple(sorted({w for own in COMMON.values() for w in own}))
#: Content words a chain; bits of a hashed chain.
CHAIN, BITS = 2, 32
#: Rows of the sample from which ranges are cut, for each range.
SAMPLED = 32


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often a lambda inside asks for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct hashed chains of a text. A text with no chain has the hash of its whole; an empty one none.

    The content words are kept in order, each with whether a common word stands just
    before it; a chain begins at each that has one. Every word is looked at a few times,
    so the cost is that of the text's length.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", " ")), " ")
    low = F.lit((1 << BITS) - 1)

    def content(own: Column) -> Column:
        known = F.transform(own, lambda w: w.isin(*WORDS))
        return bind(known, lambda k: F.filter(F.transform(own, lambda w, i: F.struct(w.alias("w"), F.get(k, i).alias("k"), F.coalesce(F.get(k, i - 1), F.lit(False)).alias("s"))), lambda x: ~x["k"] & (x["w"] != "")))

    def chains(own: Column) -> Column:
        at = lambda i: F.concat(*[F.concat(F.get(own, i + m)["w"], F.lit(" ")) for m in range(chain)])
        found = F.transform(own, lambda x, i: F.when(x["s"] & (i + chain <= F.size(own)), F.xxhash64(at(i)).bitwiseAND(low)))
        return F.sort_array(F.array_distinct(F.filter(found, lambda h: h.isNotNull())))

    sigs = bind(bind(words, content), chains)
    return bind(sigs, lambda own: F.when(text == "", F.array().cast("array<bigint>")).when(F.size(own) == 0, F.array(F.xxhash64(text).bitwiseAND(low))).otherwise(own))


def fingerprint(sigs: Column) -> Column:
    """The set as a string: its size, a colon, the chains' hashes in hexadecimal."""
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def literal(values: list, kind: str) -> Column:
    """A constant of this type, read from JSON, so that a long list is one node of the plan."""
    return F.from_json(F.lit(json.dumps(values, default=str)), kind)


def with_next(rows: DataFrame, id_col: str, tie_col: str, carry: list[str]) -> DataFrame:
    """Each row with the columns ``carry`` of the next one by descending id (after the last: the first), as next_<name>.

    Equal ids go by the hash of ``tie_col`` and then by it, null ids come last. Rows are cut
    into ranges of (id, hash), each a window of its own, so that equal ids part as well; the
    first row of each range is also laid at the end of the one before. The ranges come from
    a sample of a fixed number of rows a shuffle partition, and only it and the ranges' ends
    reach the driver. Ids may be of any type that JSON and an order know: numbers, text, dates.
    """
    spark = rows.sparkSession
    k = max(2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = f"struct<i:{dict(rows.dtypes)[id_col]},h:bigint>"
    key = F.struct(F.col(id_col).alias("i"), F.xxhash64(tie_col).alias("h"))
    sample = rows.select(key.alias("key")).orderBy(F.xxhash64("key.i", "key.h", F.lit(1))).limit(SAMPLED * k)
    got = [r[0].asDict() for r in sample.orderBy("key").collect()]
    cuts = [got[len(got) * j // k] for j in range(1, k)] if len(got) > k else []
    step = max(1, math.isqrt(len(cuts)))
    # two looks, at every step-th cut and then at those between two of them
    coarse, fine = literal(cuts[::step], f"array<{kind}>"), literal([cuts[j : j + step] for j in range(0, len(cuts), step)], f"array<array<{kind}>>")
    below = F.size(F.filter(coarse, lambda c: c <= F.col("__key"))) if cuts else F.lit(0)
    part = F.when(F.col("__c") == 0, 0).otherwise((F.col("__c") - 1) * step + F.size(F.filter(F.get(fine, F.col("__c") - 1), lambda c: c <= F.col("__key")))) if cuts else F.lit(0)
    placed = rows.withColumn("__key", key).withColumn("__c", below).withColumn("__part", part.cast("int"))
    heads = {r[0]: r[1] for r in placed.groupBy("__part").agg(F.to_json(F.max("__key"))).collect()}
    order = sorted(heads, reverse=True)
    # the first row of a range also goes to the range before, that of the first range to the last
    ends = spark.createDataFrame([(p, heads[p], order[j - 1]) for j, p in enumerate(order)], "__part int, __head string, __to int")
    own = placed.join(F.broadcast(ends), "__part")
    here = F.struct(F.col("__part").alias("p"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("__to").alias("p"), F.lit(True).alias("ghost"))
    own = own.withColumn("__at", F.explode(F.when(F.to_json("__key") == F.col("__head"), F.array(here, ghost)).otherwise(F.array(here))))
    w = Window.partitionBy("__at.p").orderBy("__at.ghost", F.col("__key").desc(), tie_col)
    return own.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).where("not __at.ghost").drop("__at", "__key", "__c", "__part", "__head", "__to")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """Columns: id, n_chars, sigs, fingerprint. Nulls count as empty texts; other columns are ignored."""
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    return rows.select(id_col, F.length("__text").cast("bigint").alias("n_chars"), signatures(F.col("__text"), chain).alias("sigs")).withColumn("fingerprint", fingerprint(F.col("sigs")))


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """How like each fingerprint is to that of the text half replaced by the next document's, and to the next document's.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The next document is that by descending id, equal ids by a hash of the text and then the text; a lone
    document follows itself. Nulls count as empty texts, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text")).withColumn("sigs", signatures(F.col("text"), chain))
    both = with_next(rows, "__id", "text", ["text", "sigs"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.select("__id", n.cast("bigint").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    both = both.withColumn("edited_sigs", signatures(F.col("edited"), chain))
    return both.select(
        F.col("__id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = CHAIN) -> DataFrame:
    """Pairs (a, b, similarity) of different fingerprints, a and b the least ids that have them, and a < b.

    Sets meet only if their sizes allow the threshold: partitions by size grow by its
    inverse, and a set looks into its own and the next. Of each set only the prefix
    that a similar one must touch is dealt out, and what remains is compared by
    pruned Jaccard. Documents without text are left out.
    """
    own = fingerprints(docs, id_col=id_col, text_col=text_col, chain=chain).where(F.size("sigs") > 0)
    own = own.groupBy("fingerprint").agg(F.min(id_col).alias("id"), F.first("sigs").alias("sigs")).where("id is not null")
    n = F.size("sigs")
    own = own.withColumn("n", n).withColumn("part", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int"))
    prefix = F.slice("sigs", F.lit(1), F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1))
    # sets in the same order of hashes; one of the first n - ceil(t n) + 1 is common to any similar pair
    keys = own.select("id", "n", "part", F.explode(prefix).alias("sig"))
    left = keys.select(F.col("id").alias("a0"), F.col("n").alias("n0"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = keys.select(F.col("id").alias("b0"), F.col("n").alias("n1"), "sig", "part")
    met = left.join(right, ["sig", "part"]).where((F.col("a0") != F.col("b0")) & (F.col("n0") <= F.col("n1")) & (F.col("n0") >= F.col("n1") * threshold))
    met = met.select(F.least("a0", "b0").alias("a"), F.greatest("a0", "b0").alias("b")).distinct()
    x, y = own.select(F.col("id").alias("a"), F.col("sigs").alias("x")), own.select(F.col("id").alias("b"), F.col("sigs").alias("y"))
    return met.join(x, "a").join(y, "b").select("a", "b", likeness(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
