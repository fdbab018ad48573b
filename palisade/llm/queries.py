"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palisade.llm import byte_bpe, hard_negatives, html_text, language_id, media_flac, mixing, ngram_join, sentencepiece_chunks, simhash, suffix_dedup, token_rollups, url_rules, vector_codes
from palisade.llm.common import shared_dir, table

MODEL, BYTE_BPE = "piece_bpe_32k.model", "byte_bpe_50k.json"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), entropy=mixing.ENTROPY)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollups.replay(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/rollups-{uuid.uuid4().hex}")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_chunks.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), keep_ids=False, keep_text=False).drop("ids", "decoded")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=False).drop("kept")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_ids(table(spark, sf_dir, "documents"), size=3, percent=90)


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_flac.media_columns(table(spark, sf_dir, "documents"), keep_media=False).drop("media")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.search_every(simhash.compare_edits(table(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), relabel=7)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), keep_ids=False, keep_text=False).drop("ids", "decoded")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_language_id, op3_html_text, op4_token_counts, op5_sentencepiece, op6_suffix_dedup, op7_ngram_join, op8_flac, op9_url_filter, op10_simhash, op11_hard_negatives, op12_byte_bpe, op13_vector_codes)
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op4_token_counts": token_rollups.ORACLE_SQL,
    "op9_url_filter": url_rules.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
