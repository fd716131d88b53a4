"""Order of backlog steps: priorities, dependencies, critical paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graphs

HUB = "wildcard "


def priority_rank(priorities: Column) -> Column:
    """Place of the first priority found in the step type or description.

    A priority named twice counts with its last place; steps matching none come
    after all others.
    """
    matching = F.filter(
        F.array_distinct(priorities),
        lambda p: F.contains("type", p) | F.contains(F.lower("description"), p),
    )
    first = F.get(matching, F.lit(0))
    place = F.size(priorities) - F.array_position(F.reverse(priorities), first)
    return F.when(F.coalesce(F.size(priorities), F.lit(0)) <= 0, 0).otherwise(F.coalesce(place, F.size(priorities))).cast("int")


def prioritized_steps(steps: DataFrame, requests: DataFrame) -> DataFrame:
    """Steps with ``priority_rank``: by it and ``ordinal`` a plan is in priority order."""
    wanted = requests.select("plan_id", "priorities")
    ranked = steps.join(wanted, "plan_id", "left").withColumn("priority_rank", priority_rank(F.col("priorities")))
    return ranked.drop("priorities")


def _needs(steps: DataFrame) -> DataFrame:
    return steps.select("plan_id", F.col("id").alias("target"), F.explode("dependencies").alias("needs")).distinct()


def exact_dependencies(steps: DataFrame) -> DataFrame:
    """Edges of the dependencies that name a step; wildcards and unknown ids drop out."""
    ids = steps.select("plan_id", F.col("id").alias("source")).distinct()
    needs = _needs(steps).filter(~F.col("needs").endswith("*")).withColumnRenamed("needs", "source")
    return needs.join(ids, ["plan_id", "source"]).select("plan_id", "source", "target")


def resolved_dependencies(steps: DataFrame) -> DataFrame:
    """All dependency edges. A wildcard is a hub node between its matches and its users.

    The hub keeps the edges linear where m users of a prefix matched by n steps
    would make m x n. Prefixes are matched by an equi-join on the leading
    characters, once per prefix length a plan uses.
    """
    exact = exact_dependencies(steps)
    wild = _needs(steps).filter(F.col("needs").endswith("*")).withColumn("prefix", F.substring("needs", F.lit(1), F.length("needs") - 1))
    hubs = wild.select("plan_id", "prefix", F.length("prefix").alias("size")).distinct()
    sizes = hubs.select("plan_id", "size").distinct()
    ids = steps.select("plan_id", "id").distinct().join(sizes, "plan_id")
    leading = ids.select("plan_id", F.col("id").alias("source"), "size", F.substring("id", F.lit(1), F.col("size")).alias("prefix"))
    hub = F.concat(F.lit(HUB), "prefix", F.lit("*"))
    into = leading.join(hubs, ["plan_id", "size", "prefix"]).select("plan_id", "source", hub.alias("target"))
    out = wild.join(into.select("plan_id", F.col("target").alias("source")).distinct().withColumn(
        "needs", F.substring("source", len(HUB) + 1, 2147483647)), ["plan_id", "needs"]).select("plan_id", "source", "target")
    return exact.unionByName(into).unionByName(out).distinct()


def step_levels(steps: DataFrame) -> DataFrame:
    """``plan_id, id, level``; steps on or behind a cycle get no row."""
    edges = resolved_dependencies(steps)
    real = steps.select("plan_id", F.col("id").alias("node")).distinct().withColumn("weight", F.lit(1))
    hubs = (
        edges.filter(F.col("target").startswith(HUB))
        .select("plan_id", F.col("target").alias("node")).distinct().withColumn("weight", F.lit(0))
    )
    return graphs.topological_levels(real.unionByName(hubs), edges).withColumnRenamed("node", "id")


def ordered_steps(steps: DataFrame) -> DataFrame:
    """Steps with ``level`` in dependency order; plans with a cycle keep their input order.

    Steps of one id collapse into the last of them, at the place of the first.
    Within a level, ``priority_rank`` (if present) and ``ordinal`` decide.
    """
    levels = step_levels(steps)
    keyed = steps if "priority_rank" in steps.columns else steps.withColumn("priority_rank", F.lit(0))
    counted = keyed.groupBy("plan_id").agg(F.count_distinct("id").alias("n_ids"))
    settled = levels.groupBy("plan_id").agg(F.count("*").alias("n_settled"))
    cyclic = (
        counted.join(settled, "plan_id", "left")
        .filter(F.col("n_ids") > F.coalesce("n_settled", F.lit(0))).select("plan_id")
    )
    kept = [c for c in keyed.columns if c not in ("plan_id", "id")]
    last = keyed.groupBy("plan_id", "id").agg(
        F.min(F.struct("priority_rank", "ordinal")).alias("first"), F.max_by(F.struct(*kept), "ordinal").alias("step")
    )
    collapsed = last.join(levels, ["plan_id", "id"]).select(
        "plan_id", "id", *[F.col(f"step.{c}").alias(c) for c in kept if c not in ("priority_rank", "ordinal")],
        "first.priority_rank", "first.ordinal", "level",
    )
    acyclic = collapsed.join(cyclic, "plan_id", "left_anti")
    as_given = keyed.join(cyclic, "plan_id", "left_semi").withColumn("level", F.lit(None).cast("int"))
    return acyclic.unionByName(as_given)


ORDER = ["level", "priority_rank", "ordinal"]


def in_order(steps: DataFrame) -> DataFrame:
    """Range-sorted by plan and step order, so that a large plan spans several tasks."""
    return steps.orderBy("plan_id", *ORDER)


def first_steps(ordered: DataFrame, limit: int = 10) -> DataFrame:
    """First steps of every plan, and how many more there are."""
    order = Window.partitionBy("plan_id").orderBy(*ORDER)
    first = ordered.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    totals = ordered.groupBy("plan_id").agg(F.count("*").alias("n_steps"))
    return first.join(totals, "plan_id").select(
        "plan_id", "position", "description", "risk_level",
        F.greatest(F.col("n_steps") - limit, F.lit(0)).alias("n_more"),
    )


def critical_paths(steps: DataFrame, keep: int = 3) -> DataFrame:
    """The longest chains of exact dependencies per plan."""
    return graphs.longest_paths(exact_dependencies(steps), "plan_id", keep)
