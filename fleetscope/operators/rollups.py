"""Service and fleet rollups.

Rollups carry counts. What a service owns (files, endpoints, tables, libraries)
stays in tables of one row per item, so no array grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def service_items(facts: DataFrame) -> DataFrame:
    """``repo_id, service, kind, item`` with sums; one pass over the facts.

    All files of a service share the null item, so map-side aggregation reduces
    a hot service to one row per task before the shuffle.
    """
    tables = F.filter("db_queries", lambda q: q["table"] != "unknown")
    items = F.concat(
        F.array(F.struct(
            F.lit("file").alias("kind"), F.lit(None).cast("string").alias("item"),
            F.col("complexity").cast("long").alias("complexity"),
            F.size("endpoints").cast("long").alias("n_endpoints"),
        )),
        F.transform(
            F.array_distinct(F.transform(tables, lambda q: q["table"])),
            lambda t: F.struct(F.lit("table").alias("kind"), t.alias("item"),
                               F.lit(0).cast("long").alias("complexity"), F.lit(0).cast("long").alias("n_endpoints")),
        ),
        F.transform(
            "external_dependencies",
            lambda d: F.struct(F.lit("library").alias("kind"), d.alias("item"),
                               F.lit(0).cast("long").alias("complexity"), F.lit(0).cast("long").alias("n_endpoints")),
        ),
    )
    return (
        facts.filter(F.col("complexity").isNotNull())
        .select("repo_id", "service", F.inline(items))
        .groupBy("repo_id", "service", "kind", "item")
        .agg(F.count("*").alias("n_files"), F.sum("complexity").alias("complexity"), F.sum("n_endpoints").alias("n_endpoints"))
    )


def service_tables(facts: DataFrame) -> DataFrame:
    """Distinct known tables per service."""
    return service_items(facts).filter("kind = 'table'").select("repo_id", "service", F.col("item").alias("table"))


def service_libraries(facts: DataFrame) -> DataFrame:
    return service_items(facts).filter("kind = 'library'").select("repo_id", "service", F.col("item").alias("library"))


def service_files(facts: DataFrame) -> DataFrame:
    """Files of a service that have facts."""
    return facts.filter(F.col("complexity").isNotNull()).select("repo_id", "service", "path")


_COUNTS = ["n_files", "complexity", "n_endpoints", "n_tables", "n_external_dependencies"]


def service_rollup(facts: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Counts per service; listed services without files keep zeros."""
    is_file = F.col("kind") == "file"
    rolled = service_items(facts).groupBy("repo_id", "service").agg(
        F.sum(F.when(is_file, F.col("n_files"))).alias("n_files"),
        F.sum("complexity").alias("complexity"),
        F.sum("n_endpoints").alias("n_endpoints"),
        F.count_if(F.col("kind") == "table").alias("n_tables"),
        F.count_if(F.col("kind") == "library").alias("n_external_dependencies"),
    )
    if services is None:
        return rolled
    listed = services.select("repo_id", "service").distinct()
    return listed.join(rolled, ["repo_id", "service"], "left").fillna(0, _COUNTS)


def mean_complexity():
    """Mean complexity per file of a rollup row."""
    return F.col("complexity") / F.greatest(F.col("n_files"), F.lit(1))


def fleet_metrics(rollup: DataFrame, dependencies: DataFrame, centrality: DataFrame) -> DataFrame:
    """One row of architecture metrics per repository."""
    services = rollup.groupBy("repo_id").agg(
        F.count("*").alias("total_services"),
        F.sum("complexity").alias("complexity"),
        F.sum("n_endpoints").alias("n_endpoints"),
    )
    edges = dependencies.groupBy("repo_id").agg(F.sum("declarations").alias("total_dependencies"))
    central = centrality.groupBy("repo_id").agg(
        F.max("centrality").alias("max_centrality"), F.avg("centrality").alias("avg_centrality")
    )
    n = F.col("total_services")
    deps = F.coalesce("total_dependencies", F.lit(0))
    return services.join(edges, "repo_id", "left").join(central, "repo_id", "left").select(
        "repo_id",
        "total_services",
        deps.alias("total_dependencies"),
        (F.col("complexity") / F.greatest(n, F.lit(1))).alias("avg_service_complexity"),
        (deps / F.greatest(n * (n - 1), F.lit(1))).alias("coupling_score"),
        (F.col("n_endpoints") / F.greatest(n, F.lit(1))).alias("avg_endpoints_per_service"),
        "max_centrality",
        "avg_centrality",
    )
