"""Service dependencies, shared tables and degree centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import API_DEPENDENCY_STRENGTH
from ..functions.arrays import explode_rows
from .facts import SPAN_SEGMENTS

SALTS = 16


def _segments(path: Column) -> Column:
    """Segments after the leading slash."""
    parts = F.split(path, "/")
    return F.slice(parts, 2, F.size(parts))


def _has_name(path: Column) -> Column:
    return path.rlike("[^/]")


def _spans(segments: Column) -> Column:
    """Every run of at most ``SPAN_SEGMENTS`` whole segments. Give a column: it is read once per run."""
    count = F.size(segments)

    def runs_from(start: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.least(F.lit(SPAN_SEGMENTS), count - start)),
            lambda length: F.concat(F.lit("/"), F.array_join(F.slice(segments, start + 1, length), "/")),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), count - 1), runs_from))


def _mentions(facts: DataFrame) -> DataFrame:
    return explode_rows(facts, ["repo_id", "service"], "mentioned_paths", "mention").distinct()


def path_mentions(facts: DataFrame) -> DataFrame:
    """Distinct ``repo_id, service, span``: whole-segment path pieces a service's code mentions."""
    paths = _mentions(facts).withColumn("segments", _segments(F.col("mention")))
    spans = explode_rows(paths, ["repo_id", "service"], _spans(F.col("segments")), "span")
    return spans.filter(_has_name(F.col("span"))).distinct()


def _long_mentions(facts: DataFrame) -> DataFrame:
    """Mentions longer than a span, once per start: the leading span and the whole rest."""
    segments = F.col("segments")
    long = _mentions(facts).select("repo_id", "service", _segments(F.col("mention")).alias("segments"))
    long = long.filter(F.size(segments) > SPAN_SEGMENTS)
    starts = F.sequence(F.lit(1), F.size(segments) - SPAN_SEGMENTS)
    rest = F.transform(starts, lambda s: F.concat(F.lit("/"), F.array_join(F.slice(segments, s, F.size(segments)), "/")))
    return explode_rows(long, ["repo_id", "service"], rest, "rest").withColumn(
        "span", F.substring_index("rest", "/", SPAN_SEGMENTS + 1)
    )


def endpoint_dependencies(endpoints: DataFrame, facts: DataFrame) -> DataFrame:
    """Services whose code mentions an endpoint path of another service.

    A mention is the literal path on segment borders. That makes the search an
    equi-join on (repository, path) instead of a nested loop over service pairs.
    Paths longer than a span join on their leading span and are then compared in
    full. Both sides are deduplicated first; ``declarations`` keeps how many
    endpoints of the target share the path. A path mentioned everywhere would be
    one huge join key: the calling services of a path are spread over ``SALTS``
    parts, each joined with a copy of the few declaring rows.
    """
    path = F.col("path")
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    declared = (
        endpoints.filter(_has_name(path))
        .groupBy("repo_id", F.col("service").alias("target"), "path")
        .agg(F.count("*").alias("declarations"))
        .withColumn("full", full)
        .withColumn("is_long", F.size(_segments(F.col("full"))) > SPAN_SEGMENTS)
    )
    short = declared.filter(~F.col("is_long")).withColumn("span", F.col("full"))
    long = declared.filter("is_long").withColumn("span", F.substring_index("full", "/", SPAN_SEGMENTS + 1))
    salt = F.pmod(F.xxhash64("service"), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    key = ["repo_id", "span", "salt"]
    by_span = path_mentions(facts).withColumn("salt", salt).join(short.withColumn("salt", salts), key)
    by_rest = _long_mentions(facts).withColumn("salt", salt).join(long.withColumn("salt", salts), key).filter(
        F.startswith(F.concat("rest", F.lit("/")), F.concat("full", F.lit("/")))
    )
    columns = ["repo_id", F.col("service").alias("source"), "target", "path", "declarations"]
    found = by_span.select(*columns).unionByName(by_rest.select(*columns).distinct())
    return found.filter("source <> target").select(
        "repo_id", "source", "target", "path",
        F.lit("api").alias("dependency_type"),
        F.lit(API_DEPENDENCY_STRENGTH).alias("strength"),
        "declarations",
    )


def dependency_edges(dependencies: DataFrame) -> DataFrame:
    """The service graph: parallel dependencies collapse to one edge."""
    return dependencies.groupBy("repo_id", "source", "target").agg(F.max("strength").alias("weight"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(in + out degree) / (nodes - 1) for every node having an edge."""
    degrees = (
        edges.select("repo_id", F.explode(F.array("source", "target")).alias("service"))
        .groupBy("repo_id", "service").agg(F.count("*").alias("degree"))
    )
    nodes = degrees.groupBy("repo_id").agg(F.count("*").alias("nodes"))
    share = F.when(F.col("nodes") > 1, F.col("degree") / (F.col("nodes") - 1)).otherwise(F.lit(1.0))
    return degrees.join(nodes, "repo_id").select("repo_id", "service", "degree", share.alias("centrality"))


def dependents(rollup: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Dependency rows onto each service, zero included."""
    counts = dependencies.groupBy("repo_id", F.col("target").alias("service")).agg(
        F.sum("declarations").alias("n_dependents")
    )
    return rollup.select("repo_id", "service").join(counts, ["repo_id", "service"], "left").fillna(0, ["n_dependents"])


def shared_tables(tables: DataFrame) -> DataFrame:
    """``repo_id, table, service, n_services`` for tables two or more services use.

    Two services share a database exactly when they have a row for the same
    table here. The listing is linear in the (service, table) rows, where a list
    of service pairs would be quadratic in a table everyone uses.
    """
    users = tables.groupBy("repo_id", "table").agg(F.count("*").alias("n_services")).filter("n_services > 1")
    return tables.join(users, ["repo_id", "table"])
