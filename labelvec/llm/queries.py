"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelvec.llm import (
    bpe,
    conversation_repair,
    decontaminate,
    language_id,
    lm_scoring,
    mixing,
    near_dedup,
    quality_crf,
    quality_rules,
    suffix_dedup,
    token_counts,
    topk,
    vector_codes,
)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op1_lm_scoring(spark, sf_dir):
    """Stupid-backoff score of every text with the counts of all others."""
    scores = lm_scoring.score_documents(documents(spark, sf_dir))
    return scores.withColumn("log_score", F.round("log_score", 4))


@query
def op1_lm_scoring_trigrams(spark, sf_dir):
    """The same with words, pairs and runs of three; its steps of backoff are two."""
    scores = lm_scoring.score_documents(documents(spark, sf_dir), orders=3)
    return scores.withColumn("log_score", F.round("log_score", 4))


@query
def op2_mix_sources(spark, sf_dir):
    """Words that each document gives to a mix of 150 % of all words with weights 3, 1, 2."""
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_quality_rules(spark, sf_dir):
    """Rules of every text, and lines that too many documents of its source share."""
    return quality_rules.quality_rules(documents(spark, sf_dir))


@query
def op4_language_id(spark, sf_dir):
    """Language of every text; those with remainder 0 are held out."""
    docs = documents(spark, sf_dir)
    held_out = _remainder(5) == 0
    names, matrix = language_id.prototypes(docs.where(~held_out))
    found = language_id.languages(docs, names, matrix)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op5_minhash_near_dedup(spark, sf_dir):
    """Components of documents whose sets of two-word shingles are similar at 0.8 or more."""
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


@query
def op6_bpe_round_trip(spark, sf_dir):
    """Ids of every text and their decoding, as digests."""
    return bpe.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_quality_crf(spark, sf_dir):
    """Quality of every text; labels of rows with remainder 2 are held out."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    scores = quality_crf.quality_scores(docs, quality_crf.train(docs, labels))
    predicted = (F.col("score") >= 0.7).cast("int")
    return scores.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query
def op8_token_counts(spark, sf_dir):
    """Tokens of every text as the model's library counts them."""
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query
def op9_suffix_dedup(spark, sf_dir):
    """Passages of fifty words or more that an earlier passage of the table repeats."""
    return suffix_dedup.repeated_passages(documents(spark, sf_dir))


@query
def op10_exact_top_k(spark, sf_dir):
    """Five best rows for every row whose vec_id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query
def op11_conversation_repair(spark, sf_dir):
    """Cheapest edits that give every damaged conversation a legal order of roles."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repairs(conversation_repair.damaged(rows), dropped="dropped", turns=False)[0]


@query
def op12_decontaminate(spark, sf_dir):
    """Words of every document inside runs of ten words that a benchmark item holds too."""
    found = decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op13_vector_codes(spark, sf_dir):
    """Codes of 16 parts with 64 entries each, after two rounds over the whole table."""
    codes, books = vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return vector_codes.with_label_error(codes).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"),
    )


SQL.update(op11_conversation_repair=conversation_repair.SQL)
SQL.update(op12_decontaminate=decontaminate.SQL, op13_vector_codes=vector_codes.SQL)
SQL.update(op1_lm_scoring=lm_scoring.SQL, op3_quality_rules=quality_rules.SQL, op10_exact_top_k=topk.SQL)
