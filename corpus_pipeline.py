"""A training corpus from raw documents: quality, near copies, benchmark passages, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
result as Parquet and hands on what it reads back. Filtering stages keep all columns of
``documents`` and never change a row they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import bpe, decontaminate, minhash, quality
from fleetscope.llm.common import counted, semi_join, stored, table
from fleetscope.llm.queries import QUALITY_THRESHOLD, learnable


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from labelled rows outside the held-out fifth."""
    columns = docs.columns
    model = quality.train(docs, learnable(table(spark, sf_dir, "labels")))
    rated = quality.with_quality(docs, model, score_column="__quality")
    return rated.filter(F.col("__quality") >= QUALITY_THRESHOLD).select(*columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group; of repeated rows of one id, one. Null ids stay."""
    groups = minhash.near_duplicates(docs, width=5, percent=80)
    rest = semi_join(docs, groups.filter("NOT kept").select("doc_id"), "doc_id", "left_anti")
    repeated, n = counted(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if not n:
        return rest.select(*docs.columns)
    once = semi_join(rest, repeated, "doc_id").dropDuplicates(["doc_id"])
    return semi_join(rest, repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    leaks = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return semi_join(docs, leaks, "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs)


STAGES = [("quality", good_quality), ("near_copies", one_of_near_copies), ("benchmark", without_benchmark), ("tokens", tokens)]
#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
