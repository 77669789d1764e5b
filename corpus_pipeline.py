"""From raw documents to token ids: score, deduplicate twice, mix, encode.

All stages take whole texts of any length, rows with nulls in any column, repeated rows and further columns of any name, and
give no rows for an empty table. What a stage does with such rows is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelvec.llm import bpe, mixing, near_dedup, quality_crf, suffix_dedup
from labelvec.session import ship_package, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores 0.7 or more, fitted on ``labels``.

    Null and empty texts are scored as texts without lines; repeated rows get equal scores. Columns stay as they are.
    """
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_crf.keep_good(docs, quality_crf.train(docs, labels), least=0.7)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more).

    Texts without words are copies of nothing and stay, as do rows without a doc_id. Ties go to the smallest doc_id; rows that repeat one
    with its text become one row, other texts under its doc_id stay. Columns stay as they are.
    """
    ship_package(spark)
    return near_dedup.keep_one(docs, width=5, percent=80)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of fifty words or more that an earlier one holds.

    Texts of fewer words, null and empty ones stay; a document of which no word is left goes. The earliest is that of the least (doc_id, position);
    rows that repeat a doc_id are cut alike, rows without one not at all. Columns stay; ``n_chars`` follows the text.
    """
    ship_package(spark)
    return suffix_dedup.cut_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy or part of a document that the mix of 150 % of all words takes.

    Texts without words have nothing to give and no row. A missing source is a source of its own, the last one. Columns stay as they are.
    """
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and their decoding; null is an empty text. Other columns are left out."""
    ship_package(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = bpe.encode_and_decode(docs, path)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_crf", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mix_sources", mixing_stage),
    ("bpe_round_trip", encoding_stage),
]
# Classifier, components and tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
