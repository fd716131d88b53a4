"""Registered queries: one per operator, over the binding views."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.operators import commits, dependencies, facts, graphs, risks, rollups, smells
from fleetscope.plans import assembly, backlog, ordering
from fleetscope.session import cut_lineage, shared_folder
from fleetscope.sources import fact_store, tables
from fleetscope.sources import files as sources

from .bindings import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, so that both engines hash the same value."""
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def changes(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.map_filter(
        F.create_map(F.lit("added"), "n_added", F.lit("removed"), "n_removed"), lambda side, n: n > 0
    )
    semantic = F.array_compact(F.array("semantic_change"))
    table = view(spark, sf, "code_changes")
    return table.withColumn("line_changes", lines).withColumn("semantic_changes", semantic)


def file_facts(spark: SparkSession, sf: str, *having: str) -> DataFrame:
    """Facts of all files, or of those that have one of the facts a query lists rows of."""
    return facts.file_facts(view(spark, sf, "code_files"), having=list(having) or None)


def stored_facts(spark: SparkSession, sf: str, *having: str) -> DataFrame:
    """Facts read by several operators: parsed once, kept as a narrow table."""
    return cut_lineage(file_facts(spark, sf, *having))


def structure(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    return facts.structure_facts(view(spark, sf, "code_files"), *fields)


def _csv(column: str) -> F.Column:
    return F.filter(F.split(column, ","), lambda v: v != "")


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "plan_steps").withColumn("dependencies", _csv("depends_on")).drop("depends_on")


def commit_steps(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "commit_steps").withColumn("validation_steps", _csv("checks"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "plan_requests")


def priorities(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "plan_priorities").withColumn("priorities", _csv("wanted"))


def found_risks(spark: SparkSession, sf: str) -> DataFrame:
    return risks.distinct_risks(risks.all_risks(changes(spark, sf)))


# --- risks of changes ---------------------------------------------------------


@query
def diff_lines(spark, sf):
    return risks.diff_lines(view(spark, sf, "code_changes"))


@query
def function_signatures(spark, sf):
    return _joined(risks.function_signatures(view(spark, sf, "code_changes")), "params")


@query
def parameter_changes(spark, sf):
    return _joined(risks.parameter_changes(view(spark, sf, "code_changes")), "removed_params", "added_params")


@query
def change_risks(spark, sf):
    return risks.change_risks(view(spark, sf, "code_changes"))


@query
def text_risks(spark, sf):
    return risks.change_risks(view(spark, sf, "text_changes"))


@query
def change_set_risks(spark, sf):
    return risks.change_set_risks(view(spark, sf, "code_changes")).select(
        "change_set_id", "rule_id", "type", "severity", "description", "n_components"
    )


@query
def interface_components(spark, sf):
    return risks.interface_components(view(spark, sf, "code_changes"))


@query
def first_changed_files(spark, sf):
    return _joined(risks.first_changed_files(view(spark, sf, "code_changes")), "affected_components")


@query
def distinct_risks(spark, sf):
    return found_risks(spark, sf).drop("ordinal", "stage", "sub_ordinal")


@query
def regression_risks(spark, sf):
    found = risks.with_guidance(risks.regression_risks(view(spark, sf, "code_changes")))
    return found.select(
        "change_set_id", "priority", "ordinal", "stage", "sub_ordinal", "rule_id", "type", "severity", "description",
        "component", "mitigation", F.array_join("test_suggestions", "; ").alias("tests"),
    )


# --- facts of files ------------------------------------------------------------


@query
def file_complexity(spark, sf):
    return structure(spark, sf, "error", "complexity").select("repo_id", "path", F.col("error").isNull().alias("parses"), "complexity")


@query
def facts_of_second_run(spark, sf):
    """Facts from a store that a run before has filled, with the number of contents parsed again."""
    files, store = view(spark, sf, "code_files"), f"{shared_folder(spark)}/facts-{uuid4().hex}"
    fact_store.refresh(files, store)
    again = fact_store.refresh(files, store)
    kept = fact_store.stored_file_facts(files, store)
    return kept.select("repo_id", "path", F.col("error").isNull().alias("parses"), "complexity", F.lit(again).alias("parsed_again"))


@query
def imports(spark, sf):
    return facts.imports(structure(spark, sf, "imports"))


@query
def classes(spark, sf):
    return _joined(facts.classes(structure(spark, sf, "classes")), "methods", "bases", "decorators")


@query
def functions(spark, sf):
    return _joined(facts.functions(structure(spark, sf, "functions")), "args", "decorators")


@query
def external_dependencies(spark, sf):
    return facts.external_dependencies(file_facts(spark, sf, "external_dependencies"))


@query
def endpoints(spark, sf):
    return facts.endpoints(file_facts(spark, sf, "endpoints"))


@query
def db_queries(spark, sf):
    return facts.db_queries(file_facts(spark, sf, "db_queries"))


@query
def text_db_queries(spark, sf):
    return facts.db_queries(facts.file_facts(view(spark, sf, "text_files"), require_parse=False))


@query
def requested_files(spark, sf):
    got = sources.requested_file_facts(view(spark, sf, "file_requests"), view(spark, sf, "code_files"))
    reason = F.regexp_extract("error", "^(File not found: .*|Syntax error in [^:]*)", 1)
    return got.select("repo_id", "path", reason.alias("reason"), "complexity")


@query
def discovered_services(spark, sf):
    return sources.discover_services(view(spark, sf, "code_paths"))


@query
def mapped_services(spark, sf):
    paths = view(spark, sf, "code_files").select("repo_id", "path")
    return sources.assign_services(paths, view(spark, sf, "service_map"))


# --- rollups, dependencies, smells -----------------------------------------------


@query
def service_rollup(spark, sf):
    return rollups.service_rollup(file_facts(spark, sf), view(spark, sf, "code_files"))


@query
def mean_complexity(spark, sf):
    rolled = rollups.service_rollup(file_facts(spark, sf), view(spark, sf, "code_files"))
    return rolled.select("repo_id", "service", rollups.mean_complexity().alias("mean_complexity"))


@query
def service_tables(spark, sf):
    return rollups.service_tables(file_facts(spark, sf, "db_queries"))


@query
def service_libraries(spark, sf):
    return rollups.service_libraries(file_facts(spark, sf, "external_dependencies"))


def _dependencies(found: DataFrame) -> DataFrame:
    return dependencies.endpoint_dependencies(facts.endpoints(found), found)


def _metrics(found: DataFrame) -> DataFrame:
    calls = cut_lineage(_dependencies(found))
    central = dependencies.degree_centrality(dependencies.dependency_edges(calls))
    return rollups.fleet_metrics(rollups.service_rollup(found, found), calls, central)


@query
def endpoint_dependencies(spark, sf):
    return _dependencies(stored_facts(spark, sf, "endpoints", "mentioned_paths"))


@query
def dependency_edges(spark, sf):
    return dependencies.dependency_edges(_dependencies(stored_facts(spark, sf, "endpoints", "mentioned_paths")))


@query
def degree_centrality(spark, sf):
    edges = view(spark, sf, "service_edges")
    return dependencies.degree_centrality(edges)


@query
def fleet_metrics(spark, sf):
    return _metrics(stored_facts(spark, sf))


@query
def dependents(spark, sf):
    found = stored_facts(spark, sf)
    return dependencies.dependents(rollups.service_rollup(found, found), _dependencies(found))


@query
def shared_tables(spark, sf):
    return dependencies.shared_tables(rollups.service_tables(stored_facts(spark, sf, "db_queries")))


@query
def sharing_groups(spark, sf):
    return graphs.sharing_groups(rollups.service_tables(file_facts(spark, sf, "db_queries")))


@query
def service_smells(spark, sf):
    return smells.service_smells(rollups.service_rollup(file_facts(spark, sf)))


@query
def shared_database_smells(spark, sf):
    return smells.shared_database_smells(dependencies.shared_tables(rollups.service_tables(stored_facts(spark, sf, "db_queries"))))


def _smells(found: DataFrame) -> DataFrame:
    shared = smells.shared_database_smells(dependencies.shared_tables(rollups.service_tables(found)))
    return smells.service_smells(rollups.service_rollup(found)).unionByName(shared)


@query
def smells_by_type(spark, sf):
    found = stored_facts(spark, sf)
    return _smells(found).groupBy("repo_id", "type").agg(F.count("*").alias("n_smells"))


@query
def circular_dependencies(spark, sf):
    return _joined(graphs.simple_cycles(view(spark, sf, "service_edges")), "cycle")


@query
def circular_groups(spark, sf):
    edges = dependencies.dependency_edges(_dependencies(stored_facts(spark, sf, "endpoints", "mentioned_paths")))
    return graphs.strong_components(edges).withColumnRenamed("node", "service")


@query
def over_complex_services(spark, sf):
    return smells.over_complex_services(rollups.service_rollup(file_facts(spark, sf)))


@query
def unversioned_endpoints(spark, sf):
    return smells.unversioned_endpoints(facts.endpoints(file_facts(spark, sf, "endpoints")))


@query
def first_unversioned(spark, sf):
    return smells.first_unversioned(facts.endpoints(file_facts(spark, sf, "endpoints")))


@query
def database_advice(spark, sf):
    return smells.database_advice(rollups.service_rollup(file_facts(spark, sf)))


@query
def high_coupling(spark, sf):
    found = stored_facts(spark, sf)
    central = dependencies.degree_centrality(dependencies.dependency_edges(_dependencies(found)))
    return smells.high_coupling(central, rollups.service_rollup(found, found))


@query
def single_points_of_failure(spark, sf):
    found = stored_facts(spark, sf)
    return smells.single_points_of_failure(dependencies.dependents(rollups.service_rollup(found, found), _dependencies(found)))


# --- backlog ----------------------------------------------------------------------


@query
def prioritized_steps(spark, sf):
    return ordering.prioritized_steps(steps(spark, sf), priorities(spark, sf)).select(
        "plan_id", "ordinal", "id", "priority_rank"
    )


@query
def resolved_dependencies(spark, sf):
    return ordering.resolved_dependencies(steps(spark, sf))


@query
def exact_dependencies(spark, sf):
    return ordering.exact_dependencies(steps(spark, sf))


@query
def step_levels(spark, sf):
    return ordering.step_levels(steps(spark, sf))


@query
def ordered_steps(spark, sf):
    ranked = ordering.prioritized_steps(steps(spark, sf), priorities(spark, sf))
    return ordering.in_order(ordering.ordered_steps(ranked)).select(
        "plan_id", "id", "ordinal", "priority_rank", "level", "type", "description", "estimated_effort", "risk_level"
    )


@query
def first_steps(spark, sf):
    return ordering.first_steps(ordering.ordered_steps(steps(spark, sf)))


@query
def critical_paths(spark, sf):
    return _joined(ordering.critical_paths(steps(spark, sf)), "path")


@query
def risk_distribution(spark, sf):
    return assembly.risk_distribution(steps(spark, sf))


@query
def plan_totals(spark, sf):
    return assembly.plan_totals(steps(spark, sf))


def _flat(steps_: DataFrame) -> DataFrame:
    flat = _joined(steps_, "target_files", "dependencies", "validation_steps")
    return flat.withColumn("stage", F.col("ordinal.stage")).withColumn("subject", F.col("ordinal.subject")).drop(
        "ordinal", "rollback_strategy"
    )


def _backlog(found: DataFrame, plans: DataFrame) -> DataFrame:
    rolled = rollups.service_rollup(found)
    declared = facts.endpoints(found)
    return backlog.backlog_steps(
        plans, rolled, dependencies.endpoint_dependencies(declared, found),
        graphs.sharing_groups(rollups.service_tables(found)), declared, smells.service_smells(rolled),
    )


@query
def domain_driven_steps(spark, sf):
    return _flat(backlog.domain_driven_steps(requests(spark, sf), rollups.service_rollup(file_facts(spark, sf))))


@query
def event_driven_steps(spark, sf):
    return _flat(backlog.event_driven_steps(requests(spark, sf), _dependencies(stored_facts(spark, sf, "endpoints", "mentioned_paths"))))


@query
def microservice_steps(spark, sf):
    found = stored_facts(spark, sf, "db_queries", "endpoints")
    groups = graphs.sharing_groups(rollups.service_tables(found))
    return _flat(backlog.microservice_steps(requests(spark, sf), groups, facts.endpoints(found)))


@query
def generic_steps(spark, sf):
    found = smells.service_smells(rollups.service_rollup(file_facts(spark, sf)))
    return _flat(backlog.generic_steps(requests(spark, sf), found))


@query
def backlog_by_plan(spark, sf):
    return _backlog(stored_facts(spark, sf), requests(spark, sf)).groupBy("plan_id", "type", "risk_level").agg(
        F.count("*").alias("n_steps"), F.sum("estimated_effort").alias("effort")
    )


@query
def step_files(spark, sf):
    found = stored_facts(spark, sf)
    plans = requests(spark, sf)
    split = backlog.domain_driven_steps(plans, rollups.service_rollup(found))
    versioned = backlog.microservice_steps(
        plans, graphs.sharing_groups(rollups.service_tables(found)), facts.endpoints(found)
    )
    return backlog.step_files(split.unionByName(versioned), rollups.service_files(found))


@query
def success_criteria(spark, sf):
    return backlog.success_criteria(requests(spark, sf), _metrics(stored_facts(spark, sf)))


@query
def assembled_plans(spark, sf):
    found = stored_facts(spark, sf)
    plans = requests(spark, sf)
    ordered = cut_lineage(ordering.ordered_steps(cut_lineage(_backlog(found, plans))))
    return assembly.assembled_plans(
        plans, assembly.plan_totals(ordered), backlog.success_criteria(plans, _metrics(found)),
        ordering.critical_paths(ordered),
    )


@query
def run_summary(spark, sf):
    found = stored_facts(spark, sf)
    plans = requests(spark, sf)
    totals = assembly.plan_totals(_backlog(found, plans))
    totalled = plans.join(totals, "plan_id", "left").fillna(0, ["n_steps", "total_effort"])
    return assembly.run_summary(totalled, _metrics(found), _smells(found))


# --- commits and releases ------------------------------------------------------------


def stored_risks(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(found_risks(spark, sf))


def _commits(spark, sf, found=None):
    found = stored_risks(spark, sf) if found is None else found
    return commits.commit_records(commit_steps(spark, sf), changes(spark, sf), found)


def _results(spark, sf):
    found = stored_risks(spark, sf)
    return commits.step_results(commit_steps(spark, sf), _commits(spark, sf, found), found)


def _run(spark, sf):
    """The executed steps, and all risks."""
    found = stored_risks(spark, sf)
    planned = commit_steps(spark, sf)
    results = commits.step_results(planned, _commits(spark, sf, found), found)
    return commits.executed_steps(planned, results), found


@query
def change_summary(spark, sf):
    summed = commits.change_set_summary(changes(spark, sf))
    return summed.select(
        "change_set_id", "n_changes", "lines_added", "lines_removed",
        F.array_join(commits.change_summary_lines(), "; ").alias("summary"),
    )


@query
def commit_scopes(spark, sf):
    return commits.change_set_summary(changes(spark, sf)).select("change_set_id", commits.scope().alias("scope"))


@query
def commit_types(spark, sf):
    return steps(spark, sf).select(
        "plan_id", "ordinal", commits.commit_type(F.col("description"), F.col("type")).alias("commit_type")
    )


@query
def semantic_changes(spark, sf):
    return _joined(commits.first_semantic_changes(changes(spark, sf)), "semantic")


@query
def commit_records(spark, sf):
    return _commits(spark, sf)


@query
def commit_messages(spark, sf):
    return _commits(spark, sf).select("plan_id", "step_id", commits.full_message().alias("full_message"))


@query
def commit_gate(spark, sf):
    return _commits(spark, sf).select("plan_id", "step_id", commits.passes_gate().alias("passed"))


@query
def commit_impact(spark, sf):
    impact = commits.commit_impact(_commits(spark, sf), changes(spark, sf))
    return impact.select("plan_id", "step_id", "message", "files_changed", "lines_added", "lines_removed")


@query
def step_results(spark, sf):
    return _results(spark, sf)


@query
def execution_summary(spark, sf):
    return commits.execution_summary(_results(spark, sf))


@query
def execution_progress(spark, sf):
    return commits.execution_progress(_results(spark, sf))


@query
def severity_report(spark, sf):
    return commits.severity_report(commit_steps(spark, sf), found_risks(spark, sf))


@query
def release_commits(spark, sf):
    found = stored_risks(spark, sf)
    made = cut_lineage(_commits(spark, sf, found))
    return commits.release_commits(made, commits.step_results(commit_steps(spark, sf), made, found))


@query
def release_risks(spark, sf):
    return commits.release_risks(*_run(spark, sf))


@query
def test_suggestions(spark, sf):
    return commits.test_suggestions(*_run(spark, sf))


@query
def first_test_suggestions(spark, sf):
    return commits.first_test_suggestions(*_run(spark, sf))


@query
def ledger_state(spark, sf):
    """The latest commit of every step, from a ledger whose run was written twice."""
    path, entries = f"{shared_folder(spark)}/ledger-{uuid4().hex}", view(spark, sf, "ledger").withColumnRenamed("made_at", "timestamp")
    for _ in range(2):
        tables.append_ledger(entries, path)
    ledger = tables.read_ledger(spark, path)
    size = ledger.groupBy("plan_id", "step_id").agg(F.count("*").alias("n_entries"))
    return tables.ledger_state(ledger).drop("timestamp").join(size, ["plan_id", "step_id"])
