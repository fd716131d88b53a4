"""Plan totals, risk figures and the assembled plan row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalogue import MITIGATION_STRATEGIES, STEP_RISK_SCORES


def risk_distribution(steps: DataFrame) -> DataFrame:
    return steps.groupBy("plan_id", "risk_level").agg(F.count("*").alias("n_steps"))


def plan_totals(steps: DataFrame) -> DataFrame:
    """Steps, effort, high-risk steps and risk score per plan."""
    level = F.col("risk_level")
    score = F.lit(1)
    for name, points in STEP_RISK_SCORES.items():
        score = F.when(level == name, points).otherwise(score)
    return steps.groupBy("plan_id").agg(
        F.count("*").alias("n_steps"),
        F.sum("estimated_effort").alias("total_effort"),
        F.count_if(level == "high").alias("high_risk_count"),
        F.sum(score).alias("total_risk_score"),
    )


def assembled_plans(requests: DataFrame, totals: DataFrame, criteria: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per plan; steps, criteria and paths stay tables keyed by ``plan_id``."""
    n_criteria = criteria.groupBy("plan_id").agg(F.count("*").alias("n_criteria"))
    longest = paths.groupBy("plan_id").agg(F.max(F.size("path")).alias("critical_path_steps"))
    zeros = ["n_steps", "total_effort", "high_risk_count", "total_risk_score", "n_criteria", "critical_path_steps"]
    joined = requests.join(totals, "plan_id", "left").join(n_criteria, "plan_id", "left").join(longest, "plan_id", "left")
    return joined.fillna(0, zeros).select(
        "plan_id", "repo_id", "target_architecture", "safety_level", *zeros,
    )


def with_plan_notes(plans: DataFrame) -> DataFrame:
    """Adds creation time and the fixed mitigation strategies."""
    return plans.withColumn("created_at", F.localtimestamp()).withColumn(
        "mitigation_strategies", F.array(*[F.lit(s) for s in MITIGATION_STRATEGIES])
    )


def run_summary(plans: DataFrame, metrics: DataFrame, smells: DataFrame) -> DataFrame:
    """Figures of the closing report, one row per plan."""
    found = smells.groupBy("repo_id").agg(F.count("*").alias("n_smells"))
    figures = metrics.select("repo_id", "total_services", "total_dependencies", "avg_service_complexity")
    return plans.join(figures, "repo_id", "left").join(found, "repo_id", "left").fillna(0, ["n_smells"]).select(
        "plan_id", "repo_id", "target_architecture", "safety_level", "total_services", "total_dependencies", "n_smells",
        "avg_service_complexity", "n_steps", "total_effort",
    )
