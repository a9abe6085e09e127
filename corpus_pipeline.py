"""Corpus pipeline: quality classifier, exact dedup, near-duplicate join, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlens.llm import cost_packing, exact_dedup, lsh_forest, quality
from threatlens.llm.common import settle, table
from threatlens.llm.queries import QUALITY_THRESHOLD, tokenizer_path
from threatlens.llm.words import MEMORY


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated probability of quality 1 reaches the threshold."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), score_col="_quality_score")
    return scored.filter(F.col("_quality_score") >= QUALITY_THRESHOLD).drop("_quality_score")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.drop_copies(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id; documents without id stay."""
    return lsh_forest.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that stayed, in sequences of 1024 tokens; workers still hold what earlier stages kept."""
    return cost_packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, word_memory=MEMORY).drop("ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_one_copy),
    ("n-gram Jaccard join", keep_one_of_near),
    ("packing", packed),
]
#: A classifier and MinHash have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    *filters, (_, last) = STAGES
    for name, stage in filters:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return last(spark, docs, sf_dir)
