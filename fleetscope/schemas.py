"""Table schemas and value checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import SAFETY_LEVELS, SEVERITIES, STEP_TYPES

SOURCE_FILES = "repo_id STRING, service STRING, path STRING, content STRING"
CHANGES = (
    "change_set_id STRING, ordinal BIGINT, file_path STRING, change_type STRING, diff STRING, "
    "line_changes MAP<STRING,INT>, semantic_changes ARRAY<STRING>"
)
STEPS = (
    "plan_id STRING, ordinal BIGINT, id STRING, type STRING, description STRING, target_files ARRAY<STRING>, "
    "dependencies ARRAY<STRING>, estimated_effort INT, risk_level STRING, rollback_strategy STRING, "
    "validation_steps ARRAY<STRING>, commit_message STRING"
)
SERVICE_DEPENDENCIES = (
    "repo_id STRING, source STRING, target STRING, path STRING, dependency_type STRING, strength DOUBLE, "
    "declarations BIGINT"
)
PLAN_REQUESTS = (
    "plan_id STRING, repo_id STRING, target_architecture STRING, safety_level STRING, priorities ARRAY<STRING>"
)
LEDGER = "plan_id STRING, step_id STRING, commit_id STRING, timestamp TIMESTAMP, message STRING"

_ALLOWED = {"type": STEP_TYPES, "safety_level": SAFETY_LEVELS, "severity": SEVERITIES}


def allowed(column: str) -> Column:
    """True where ``column`` holds one of its permitted values."""
    return F.col(column).isin(_ALLOWED[column])


def unit_interval(column: str) -> Column:
    return F.col(column).between(0.0, 1.0)


def violations(df: DataFrame, *checks: Column) -> DataFrame:
    """Rows failing any of ``checks``; a null value is not a failure."""
    bad = F.lit(False)
    for check in checks:
        bad = bad | ~F.coalesce(check, F.lit(True))
    return df.filter(bad)
