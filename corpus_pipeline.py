"""The corpus pipeline: documents to training ids, in five stages, each written as Parquet and read by the next.

Null and empty texts are rejected by the first stage, as they have no language. Rows that repeat a doc_id with its text
are one document to the second stage and pass it together; of a group the smallest doc_id stays, and so do documents
that have none. Texts of any length are taken whole. An empty table passes all stages empty. Of
other columns than those of documents nothing is read, so that their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import language_id, mixing, ngram_join, sentencepiece_chunks, suffix_dedup
from palisade.llm.common import materialise, remove, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose words have a lower mean probability, each of its own best language, than this are rejected, as are
#: those without a letter. Text in several languages is kept, however small the share of each.
LEAST_SCORE = 0.4
#: Near duplicates: word shingles and percent of Jaccard similarity.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: The mixture is as even as it can be if no source is taken more often than this, and the budget is the least that takes
#: every document. Up to about four passes over the same text are as good as new text to a model.
MOST_REPEATS = 4
#: Sources that hold this part of all tokens together are taken as often as that, and leave the exponent to the others.
RARE = 0.01


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of recognised languages; the model is fitted on labelled documents of the same table."""
    found = language_id.identify(docs, language_id.train(docs), keep=COLUMNS, sure=True)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("sure") >= LEAST_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of linked documents, and all that have no link."""
    named = ngram_join.component_ids(docs, size=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    gone = named.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that stand earlier in the corpus; a character that loses a byte goes whole. A document
    of which nothing is left goes."""
    others = tuple(c for c in COLUMNS if c not in ("text", "n_chars"))
    kept = suffix_dedup.remove_repeats(docs, more=others).filter("n_removed < n_bytes or n_bytes = 0")
    # the parts of cut characters become U+FFFD, which a text that had none loses again
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(F.is_valid_utf8(F.col("kept").cast("string")), F.col("kept").cast("string")).otherwise(F.replace(text, F.lit("�"), F.lit("")))
    return kept.select("row.*", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: small sources up to MOST_REPEATS times as often as the largest."""
    mixed = mixing.mix(docs, repeats=MOST_REPEATS, budget="cover", rare=RARE, keep=(F.struct(*COLUMNS).alias("row"),))
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded text."""
    return sentencepiece_chunks.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=False).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("ngram_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The language model and the tokenizer can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what the stage itself writes on its way
            docs = materialise(stage(spark, docs, sf_dir), name, keep=True)
        remove(spark, before)
        before = sorted({f.rsplit("/", 1)[0] for f in docs.inputFiles()})
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
