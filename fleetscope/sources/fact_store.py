"""Facts of file contents, kept by digest: a rerun parses only contents it has not met.

The store is one Parquet table of facts per content digest and parser version. It grows by appends,
which Spark commits as a whole: after a failed run its rows are simply missing, and parsed by the next.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import file_facts

#: To be raised whenever facts of the same text change.
PARSER_VERSION = 1
#: Up to so many paths to parse are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_PATHS = 1_000_000


def content_digest(content: Column) -> Column:
    """SHA-256 of a text; a missing text has a digest of its own."""
    return F.coalesce(F.sha2(content.cast("binary"), 256), F.lit("missing"))


def known_facts(spark: SparkSession, store: str, version: int = PARSER_VERSION) -> DataFrame | None:
    """``digest`` and its facts as ``version`` parsed them, each digest once; None while there is no store."""
    try:
        kept = spark.read.parquet(store)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # Two runs at the same time may both have parsed a content.
    return kept.filter(F.col("version") == version).drop("version").dropDuplicates(["digest"])


def _digests(files: DataFrame) -> DataFrame:
    return files.select("repo_id", "path", content_digest(F.col("content")).alias("digest"))


def refresh(files: DataFrame, store: str, version: int = PARSER_VERSION, broadcast_paths: int = BROADCAST_PATHS) -> int:
    """Parses the contents of ``files`` that the store lacks and appends their facts; gives their number.

    Only digests are compared; of the files of one new content, that of the smallest ``repo_id, path`` is parsed.
    """
    named, known = _digests(files), known_facts(files.sparkSession, store, version)
    missing = named if known is None else named.join(known.select("digest"), "digest", "left_anti")
    chosen = missing.groupBy("digest").agg(F.min(F.struct("repo_id", "path")).alias("at")).persist()
    try:
        n = chosen.count()
        if n:
            here = files.select(F.struct("repo_id", "path").alias("at"), content_digest(F.col("content")).alias("digest"), "content")
            wanted = F.broadcast(chosen) if n <= broadcast_paths else chosen
            at, digest = here["at"].eqNullSafe(chosen["at"]), here["digest"] == chosen["digest"]
            texts = here.join(wanted, at & digest, "left_semi").select(F.col("digest").alias("path"), "content")
            parsed = file_facts(texts).withColumnRenamed("path", "digest").withColumn("version", F.lit(version))
            parsed.write.mode("append").parquet(store)
    finally:
        chosen.unpersist()
    return n


def stored_file_facts(files: DataFrame, store: str, version: int = PARSER_VERSION) -> DataFrame:
    """The rows of ``file_facts``, parsed or read from the store, with the ``digest`` of each content."""
    refresh(files, store, version)
    return _digests(files).join(known_facts(files.sparkSession, store, version), "digest")
