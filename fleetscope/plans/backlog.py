"""Backlog steps: rules over rollups, joined to the migration requests.

``requests`` holds one row per plan: ``plan_id, repo_id, target_architecture,
safety_level`` and optionally ``priorities``. Every branch keeps only the
requests of its target. A step's place among the generated ones is ``ordinal``, a
(stage, subject) struct: sortable without numbering a whole plan in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import (
    ASYNC_STRENGTH,
    BASE_CRITERIA,
    CONTEXT_SPLIT_ENDPOINTS,
    COUPLING_LIMIT,
    STEP_TEMPLATES,
    TARGET_CRITERIA,
    VERSIONING_FILE_WORDS,
)
from ..functions import text
from ..operators.smells import unversioned_endpoints

STEP_FIELDS = [
    "ordinal", "id", "type", "description", "target_files", "dependencies", "estimated_effort", "risk_level",
    "rollback_strategy", "validation_steps", "commit_message",
]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _filled(template: str, subjects: dict[str, Column]) -> Column:
    filled = F.lit(template)
    for name, value in subjects.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    return filled


def _step(key: str, stage: int, risk_level: Column | None = None, description: Column | None = None,
          **subjects: Column) -> Column:
    template = STEP_TEMPLATES[key]
    named = {("" if name == "subject" else name): value for name, value in subjects.items()}
    place = F.concat_ws("-", *subjects.values()) if subjects else F.lit("")
    own = _filled(template.description, named)
    return F.struct(
        F.struct(F.lit(stage).alias("stage"), place.alias("subject")).alias("ordinal"),
        _filled(template.id, named).alias("id"),
        F.lit(template.type).alias("type"),
        (own if description is None else F.coalesce(F.nullif(description, F.lit("")), own)).alias("description"),
        _strings(template.target_files).alias("target_files"),
        _strings(template.dependencies).alias("dependencies"),
        F.lit(template.effort).alias("estimated_effort"),
        (F.lit(template.risk_level) if risk_level is None else risk_level).alias("risk_level"),
        F.lit(None).cast("string").alias("rollback_strategy"),
        _strings(template.validation_steps).alias("validation_steps"),
        _filled(template.commit_message, named).alias("commit_message"),
    )


def _emit(df: DataFrame, *steps: Column) -> DataFrame:
    listed = F.array_compact(F.array(*steps))
    return df.select("plan_id", "repo_id", F.inline(listed))


def _requests_for(requests: DataFrame, target: str) -> DataFrame:
    return requests.filter(F.col("target_architecture") == target).select("plan_id", "repo_id", "safety_level")


def domain_driven_steps(requests: DataFrame, rollup: DataFrame) -> DataFrame:
    plans = _requests_for(requests, "domain-driven")
    crowded = rollup.filter(F.col("n_endpoints") > CONTEXT_SPLIT_ENDPOINTS).select("repo_id", "service")
    split = _emit(plans.join(crowded, "repo_id"), _step("extract_context", 1, subject=F.col("service")))
    fixed = _emit(plans, _step("aggregates", 2), _step("domain_events", 3), _step("repositories", 4))
    return split.unionByName(fixed)


def event_driven_steps(requests: DataFrame, dependencies: DataFrame) -> DataFrame:
    plans = _requests_for(requests, "event-driven")
    calls = (
        dependencies.filter((F.col("dependency_type") == "api") & (F.col("strength") > ASYNC_STRENGTH))
        .select("repo_id", "source", "target").distinct()
    )
    level = F.when(F.col("safety_level") == "high", "high").otherwise("medium")
    converted = _emit(
        plans.join(calls, "repo_id"),
        _step("async_call", 2, risk_level=level, source=F.col("source"), target=F.col("target")),
    )
    sourcing = F.when(F.col("safety_level") != "low", _step("event_sourcing", 3))
    return converted.unionByName(_emit(plans, _step("broker", 1), sourcing))


def microservice_steps(requests: DataFrame, groups: DataFrame, endpoints: DataFrame) -> DataFrame:
    """A group of services sharing tables is named by its seed; its members are the rows of ``groups``."""
    plans = _requests_for(requests, "microservices")
    seeds = groups.select("repo_id", "seed").distinct()
    separated = _emit(plans.join(seeds, "repo_id"), _step("separate_db", 1, subject=F.col("seed")))
    unversioned = unversioned_endpoints(endpoints).select("repo_id", "service").distinct()
    versioned = _emit(plans.join(unversioned, "repo_id"), _step("api_versioning", 2, subject=F.col("service")))
    mesh = _emit(plans.filter("safety_level = 'high'"), _step("service_mesh", 3))
    return separated.unionByName(versioned).unionByName(mesh)


def generic_steps(requests: DataFrame, smells: DataFrame) -> DataFrame:
    named = F.col("target_architecture").isin(list(TARGET_CRITERIA))
    plans = requests.filter(~named).select("plan_id", "repo_id")
    wanted = smells.filter(F.col("type").isin("god_service", "high_complexity", "dead_code"))
    # All dead code of a repository is one step.
    subject = F.when(F.col("type") != "dead_code", F.col("location"))
    found = (
        wanted.select("repo_id", "type", subject.alias("location"),
                      F.when(F.col("type") != "dead_code", F.col("suggested_fix")).alias("suggested_fix"))
        .distinct()
    )
    location, fix = F.col("location"), F.col("suggested_fix")
    by_type = (
        F.when(F.col("type") == "god_service", _step("split_god", 1, description=fix, subject=location))
        .when(F.col("type") == "high_complexity", _step("reduce_complexity", 2, description=fix, subject=location))
        .when(F.col("type") == "dead_code", _step("dead_code", 3))
    )
    return _emit(plans.join(found, "repo_id"), by_type)


def backlog_steps(requests: DataFrame, rollup: DataFrame, dependencies: DataFrame, groups: DataFrame,
                  endpoints: DataFrame, smells: DataFrame) -> DataFrame:
    """The steps of every plan, each by the rules of its target architecture."""
    return (
        domain_driven_steps(requests, rollup)
        .unionByName(event_driven_steps(requests, dependencies))
        .unionByName(microservice_steps(requests, groups, endpoints))
        .unionByName(generic_steps(requests, smells))
    )


def step_files(steps: DataFrame, service_files: DataFrame) -> DataFrame:
    """``plan_id, step_id, path`` of the steps that work on a service's own files.

    Splitting a service touches all its files, versioning those that look like
    route files. One row per file: a service may own any number.
    """
    prefixes = {key: STEP_TEMPLATES[key].id.partition("{}")[0] for key in ("extract_context", "api_versioning")}
    id_ = F.col("id")
    all_files = id_.startswith(prefixes["extract_context"])
    own = steps.filter(all_files | id_.startswith(prefixes["api_versioning"])).select(
        "plan_id", "repo_id", F.col("id").alias("step_id"), F.col("ordinal.subject").alias("service"),
        all_files.alias("all_files"),
    )
    joined = own.join(service_files, ["repo_id", "service"])
    return joined.filter(F.col("all_files") | text.contains_any(F.col("path"), VERSIONING_FILE_WORDS)).select(
        "plan_id", "step_id", "path"
    )


def success_criteria(requests: DataFrame, metrics: DataFrame) -> DataFrame:
    """``plan_id, ordinal, criterion``."""
    target = F.col("target_architecture")
    specific = F.lit(None).cast("array<string>")
    for name, criteria in TARGET_CRITERIA.items():
        specific = F.when(target == name, _strings(criteria)).otherwise(specific)
    coupling = F.concat(
        F.lit(f"Coupling score reduced below {COUPLING_LIMIT} (current: "), text.fixed(F.col("coupling_score"), 2), F.lit(")")
    )
    listed = F.concat(
        _strings(BASE_CRITERIA),
        F.coalesce(specific, _strings([])),
        F.when(F.col("coupling_score") > COUPLING_LIMIT, F.array(coupling)).otherwise(_strings([])),
    )
    joined = requests.join(metrics.select("repo_id", "coupling_score"), "repo_id", "left")
    return joined.select("plan_id", F.posexplode(listed).alias("ordinal", "criterion"))
