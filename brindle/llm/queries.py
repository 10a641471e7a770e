"""Queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

import public_tokenizers

from . import bpe, chunks, langid, lines, matroska, mixing, ngramjoin, pii, spotsigs, suffixes


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark, sf_dir):
    return lines.dedup(_docs(spark, sf_dir))


def op2_language_id(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    model = langid.fit(docs, ~langid.held_out())
    out = langid.predict(docs, model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_substring_dedup(spark, sf_dir):
    return chunks.dedup(_docs(spark, sf_dir))


def op4_pii(spark, sf_dir):
    return pii.detect(_docs(spark, sf_dir))


def op5_suffix_dedup(spark, sf_dir):
    return suffixes.dedup(_docs(spark, sf_dir), keep="none")


def op6_matroska(spark, sf_dir):
    return matroska.media_column(_docs(spark, sf_dir))


def op7_bpe(spark, sf_dir):
    return bpe.bpe_encode(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op8_spotsigs(spark, sf_dir):
    return spotsigs.edited_likeness(_docs(spark, sf_dir))


def op9_mixing(spark, sf_dir):
    return mixing.mix(_docs(spark, sf_dir))


def op10_ngram_join(spark, sf_dir):
    return ngramjoin.join(_docs(spark, sf_dir))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"pipeline": pipeline}


def oracle_sql():
    return {}
