"""A training corpus from raw documents: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet to the shared folder
and read again as the next stage's docs. All but the last return the columns of documents.

Rows, in every stage: a null text counts as empty and stays null where its document stays; repeated rows are documents
of their own (near_copies keeps one of them); columns beyond those of documents are left out, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import line_dedup, ngram_join, packing, quality, secret_scan
from netloom.llm.common import discard, documents, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: For packing: its workers have to fit beside a JVM that the stages before have filled.
CACHED_WORDS, BLOCK_BYTES = 400_000, 4 << 20


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents the classifier accepts; learns from the labels outside the held-out fold. Null and empty texts
    are scored like others; without labels of two classes all documents have one score."""
    docs = docs.select(*COLUMNS)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of recurring templates, and documents that consist of nothing else. Null and empty texts stay."""
    left = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return _counted(left.where(~((F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("text", "[\\s]+", " ")) == ""))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near copies; documents without an id stay.

    Different texts of one id are documents of their own: each goes by a hash of id and text, after all ids.
    """
    docs = docs.select(*COLUMNS)
    text = F.xxhash64("doc_id", "text")
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b"))
    several = ids.where("a <> b").select("doc_id", F.lit(True).alias("_several"))
    if several.isEmpty():
        keyed = docs.withColumn("_id", F.col("doc_id"))
    else:
        own = F.shiftrightunsigned(text, 2).bitwiseOR(F.lit(1 << 62))
        keyed = docs.join(several, "doc_id", "left").select(*COLUMNS, F.when(F.col("_several"), own).otherwise(F.col("doc_id")).alias("_id"))
    groups = ngram_join.near_duplicates(keyed.withColumn("doc_id", F.col("_id")).drop("_id"))
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    named = keyed.where("_id IS NOT NULL").join(first, "_id", "left_semi").dropDuplicates(["_id"]).select(*COLUMNS)
    return named.union(docs.where("doc_id IS NULL"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; no document goes."""
    return _counted(secret_scan.redacted(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, mixed by source."""
    return packing.pack(docs, cached_words=CACHED_WORDS, block_bytes=BLOCK_BYTES)


STAGES = [
    ("quality_filter", quality_filter),
    ("template_lines", template_lines),
    ("near_copies", near_copies),
    ("secrets_redacted", secrets_redacted),
    ("packed", packed),
]

#: SQL can express neither the classifier nor tokenization. tests/llm/test_stages_brute_force.py holds the three stages
#: between them against SQL and brute force, and the tests of their operators the other two.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
