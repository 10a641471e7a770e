"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet into the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from brindle.llm import bpe, langid, lines, mixing, ngramjoin
from brindle.llm.common import Scratch


def language_id(spark, docs, sf_dir):
    """Documents whose language is recognised; one without letters, or far from every centroid, goes."""
    return langid.reject(docs)


def line_dedup(spark, docs, sf_dir):
    """Texts without lines that an earlier line resembles; a document that has no line left goes."""
    return lines.drop_lines(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of similar ones: that with the least id."""
    return ngramjoin.keep_one(docs)


def mixing_order(spark, docs, sf_dir):
    """All documents, in the order in which the sources are mixed to their target weights."""
    return mixing.reorder(docs)


def encoding(spark, docs, sf_dir):
    """Token ids of every text, with the digests of the ids and of the decoded bytes.

    The mix is the order of the files that the stage before has written and of the rows in
    them. Readers deal files out in any order, so it is read from them and carried on:
    (mix_part, mix_row) sorts the documents as they were mixed.
    """
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"part-(\d+)", 1).cast("bigint") * 100_000 + F.coalesce(F.regexp_extract(name, r"-c(\d+)", 1).try_cast("bigint"), F.lit(0))
    try:
        docs = docs.select(*docs.columns, part.alias("mix_part"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:  # not read from files: the order of partitions and of the rows in them
        docs = docs.select(*docs.columns, F.spark_partition_id().cast("bigint").alias("mix_part"), F.monotonically_increasing_id().alias("mix_row"))
    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source", "mix_part", "mix_row"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixing_order),
    ("BPE", encoding),
]

#: No stage but the fourth can be told in SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = scratch.store(out, f"stage-{k}") if k + 1 < len(STAGES) else out
    return docs
