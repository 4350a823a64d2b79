"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import ann, bpe, divergence, embed_dedup, hard_negatives, line_dedup, ngram_join, packing, piece_bpe, quality, secret_scan, suffix_dedup, token_store
from netloom.llm.common import documents, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip_digests(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.relabelled(hard_negatives.quantised(table(spark, sf_dir, "embeddings")), every=7, labels=10)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_line_dedup": op2_line_dedup,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_token_store": op4_token_store,
        "op5_ngram_join": op5_ngram_join,
        "op6_embed_dedup": op6_embed_dedup,
        "op7_quality": op7_quality,
        "op8_packing": op8_packing,
        "op9_ann": op9_ann,
        "op10_secret_scan": op10_secret_scan,
        "op11_sentencepiece": op11_sentencepiece,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_divergence": divergence.SQL}
