"""Change-set source and the result sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHANGES, LEDGER


def read_changes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(CHANGES).format(fmt).load(path)


def write_analysis(tables: dict[str, DataFrame], root: str, run_ts: str, fmt: str = "parquet") -> None:
    """Writes every result table of a run below ``root/<table>/run_ts=...``.

    A run that is repeated under its ``run_ts`` takes the place of what it wrote before; other runs stay.
    A table without rows changes nothing.
    """
    for name, table in tables.items():
        writer = table.withColumn("run_ts", F.lit(run_ts)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("run_ts").format(fmt).save(f"{root}/{name}")


def write_plans(plans: DataFrame, root: str, run_ts: str, fmt: str = "parquet") -> None:
    """Writes plans by run: a directory per plan would not scale to many plans."""
    write_analysis({"plans": plans}, root, run_ts, fmt)


def read_plans(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """The rows each plan had in its latest run."""
    stored = spark.read.format(fmt).load(f"{root}/plans").withColumn("run_ts", F.col("run_ts").cast("string"))
    latest = stored.groupBy("plan_id").agg(F.max("run_ts").alias("run_ts"))
    return stored.join(latest, ["plan_id", "run_ts"])


def write_results(results: DataFrame, root: str, run_ts: str, fmt: str = "parquet") -> None:
    write_analysis({"results": results}, root, run_ts, fmt)


def append_ledger(commits: DataFrame, path: str) -> None:
    """Adds the distinct ``plan_id, step_id, commit_id, timestamp, message`` rows that the ledger lacks; nothing is rewritten.

    So a repeated run adds each entry once. A ledger has one writer at a time.
    """
    entries = commits.select("plan_id", "step_id", "commit_id", "timestamp", "message")
    try:
        known = read_ledger(commits.sparkSession, path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        new = entries.distinct()
    else:
        new = entries.subtract(known)
    new.write.mode("append").parquet(path)


def ledger_state(ledger: DataFrame) -> DataFrame:
    """Latest entry per step."""
    entry = F.struct("commit_id", "timestamp", "message")
    latest = ledger.groupBy("plan_id", "step_id").agg(F.max_by(entry, F.struct("timestamp", "commit_id")).alias("e"))
    return latest.select("plan_id", "step_id", "e.*")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)
