"""Smells, recommendations and risk areas: rules over the rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalogue import (
    DATABASE_ADVICE,
    GOD_SERVICE_ENDPOINTS,
    GOD_SERVICE_FIX,
    HIGH_CENTRALITY,
    HIGH_COMPLEXITY_FIX,
    HIGH_MEAN_COMPLEXITY,
    OVER_COMPLEX_SERVICE,
    SHARED_DATABASE_FIX,
    SINGLE_POINT_SHARE,
)
from ..functions import text
from .rollups import mean_complexity

SMELL = ["repo_id", "type", "severity", "location", "description", "suggested_fix"]


def _smell(kind: str, severity: str, description, fix: str):
    return F.struct(
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.col("service").alias("location"),
        description.alias("description"), F.lit(fix).alias("suggested_fix"),
    )


def service_smells(rollup: DataFrame) -> DataFrame:
    """God services and high mean complexity, in one pass over the rollup."""
    god = F.when(
        F.col("n_endpoints") > GOD_SERVICE_ENDPOINTS,
        _smell("god_service", "high",
               F.concat(F.lit("Service has "), F.col("n_endpoints").cast("string"),
                        F.lit(" endpoints, consider splitting")), GOD_SERVICE_FIX),
    )
    tangled = F.when(
        mean_complexity() > HIGH_MEAN_COMPLEXITY,
        _smell("high_complexity", "medium",
               F.concat(F.lit("Average file complexity is "), text.fixed(mean_complexity(), 1)), HIGH_COMPLEXITY_FIX),
    )
    return rollup.select("repo_id", F.inline(F.array_compact(F.array(god, tangled)))).select(*SMELL)


def shared_database_smells(shared: DataFrame) -> DataFrame:
    """One smell per service and shared table, from :func:`dependencies.shared_tables`."""
    description = F.concat(
        F.lit("Services share database tables: "), "table", F.lit(" (used by "),
        F.col("n_services").cast("string"), F.lit(" services)"),
    )
    return shared.select("repo_id", _smell("shared_database", "high", description, SHARED_DATABASE_FIX).alias("s")).select(
        "repo_id", "s.*"
    )


def over_complex_services(rollup: DataFrame) -> DataFrame:
    return rollup.filter(F.col("complexity") > OVER_COMPLEX_SERVICE).select(
        "repo_id", "service", "complexity",
        F.concat(F.lit("Consider breaking down "), "service", F.lit(" - complexity score: "),
                 F.col("complexity").cast("string")).alias("recommendation"),
    )


def unversioned_endpoints(endpoints: DataFrame) -> DataFrame:
    return endpoints.filter(~F.contains("path", F.lit("/v")))


def first_unversioned(endpoints: DataFrame, limit: int = 5) -> DataFrame:
    """The first endpoints of each repository that carry no version."""
    order = Window.partitionBy("repo_id").orderBy("service", "file_path", "ordinal")
    numbered = unversioned_endpoints(endpoints).select("repo_id", "service", "file_path", "ordinal", "path")
    first = numbered.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    return first.select("repo_id", "position", F.concat("service", F.lit(":"), "path").alias("endpoint"))


def database_advice(rollup: DataFrame) -> DataFrame:
    owning = rollup.groupBy("repo_id").agg(F.count_if(F.col("n_tables") > 0).alias("services_with_tables"))
    return owning.filter("services_with_tables > 1").withColumn("recommendation", F.lit(DATABASE_ADVICE))


def _services_per_repo(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("repo_id").agg(F.count("*").alias("n_services"))


def high_coupling(centrality: DataFrame, rollup: DataFrame) -> DataFrame:
    reached = F.floor(F.col("centrality") * F.col("n_services"))
    return (
        centrality.filter(F.col("centrality") > HIGH_CENTRALITY)
        .join(_services_per_repo(rollup), "repo_id")
        .select(
            "repo_id", F.lit("high_coupling").alias("type"), "service", F.col("centrality").alias("risk_score"),
            F.concat("service", F.lit(" is highly coupled with "), reached.cast("string"),
                     F.lit(" other services")).alias("description"),
        )
    )


def single_points_of_failure(dependents: DataFrame) -> DataFrame:
    score = F.col("n_dependents") / F.col("n_services")
    return (
        dependents.join(_services_per_repo(dependents), "repo_id")
        .filter(F.col("n_dependents") > F.col("n_services") * SINGLE_POINT_SHARE)
        .select(
            "repo_id", F.lit("single_point_of_failure").alias("type"), "service", score.alias("risk_score"),
            F.concat("service", F.lit(" is a dependency for "), F.col("n_dependents").cast("string"),
                     F.lit(" services")).alias("description"),
        )
    )


def risk_areas(centrality: DataFrame, rollup: DataFrame, dependents: DataFrame) -> DataFrame:
    return high_coupling(centrality, rollup).unionByName(single_points_of_failure(dependents))
