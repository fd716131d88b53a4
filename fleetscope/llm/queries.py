"""Registered queries of the training-data operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embeddings, filter_audit, html, lm, minhash, pair_bpe, phrases, quality, records, token_counts, warc
from .common import new_path, table

#: From this score on a text counts as good.
QUALITY_THRESHOLD = 0.3


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that a classifier may learn from; the other fifth is held out."""
    return labels.filter(id_remainder(F.col("doc_id"), 5) != 0)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), keep_ids=False)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read_records(records.write_records(table(spark, sf_dir, "documents")), checks=True)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(table(spark, sf_dir, "embeddings"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, learnable(table(spark, sf_dir, "labels")))
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    predicted = (F.col("score") >= QUALITY_THRESHOLD).cast("int")
    return quality.with_quality(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own, so that a run never profits from an earlier one."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), new_path(spark, "token-cache"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_pair_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_bpe.round_trip(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_lm_score, op3_token_records, op4_minhash, op5_warc, op6_decontamination, op7_embedding_links, op8_html_text,
        op9_quality, op10_token_counts, op11_collocations, op12_filter_audit, op13_pair_bpe,
    )
}
