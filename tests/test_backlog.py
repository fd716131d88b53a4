from helpers import rows

from fleetscope.catalogue import BASE_CRITERIA, STEP_TEMPLATES
from fleetscope.plans import assembly, backlog, ordering
from fleetscope.schemas import allowed, unit_interval, violations

STEPS = "plan_id string, ordinal int, id string, type string, description string, dependencies array<string>, estimated_effort int, risk_level string"


def steps(spark, *items, plan="p"):
    data = [(plan, i, id_, "restructure", f"step {id_} {i}", deps, 1, "high") for i, (id_, deps) in enumerate(items)]
    return spark.createDataFrame(data, STEPS)


def requests(spark, *targets, safety="high"):
    return spark.createDataFrame([(f"plan-{t}", "r", t, safety) for t in targets],
                                 "plan_id string, repo_id string, target_architecture string, safety_level string")


ROLLUP = "repo_id string, service string, n_endpoints long"
DEPS = "repo_id string, source string, target string, dependency_type string, strength double"


def test_domain_driven(spark):
    rollup = spark.createDataFrame([("r", "a", 10), ("r", "b", 11)], ROLLUP)
    got = backlog.domain_driven_steps(requests(spark, "domain-driven", "other"), rollup)
    assert rows(got, "id", "estimated_effort", "risk_level") == [
        ("create-domain-events", 16, "medium"), ("extract-context-b", 16, "medium"), ("implement-aggregates", 24, "low"),
        ("implement-repositories", 12, "low")]
    split = got.filter("id = 'extract-context-b'").first()
    assert split.description == "Extract bounded contexts from b"
    assert split.commit_message == "refactor: extract bounded contexts from b"
    assert list(split.validation_steps) == STEP_TEMPLATES["extract_context"].validation_steps


def test_event_driven(spark):
    deps = spark.createDataFrame([("r", "a", "b", "api", 0.7), ("r", "a", "b", "api", 0.7), ("r", "a", "c", "api", 0.5),
                                  ("r", "b", "c", "database", 0.9)], DEPS)
    for safety, level, extra in [("high", "high", [("implement-event-sourcing", "high")]), ("low", "medium", [])]:
        got = backlog.event_driven_steps(requests(spark, "event-driven", safety=safety), deps)
        assert rows(got, "id", "risk_level") == sorted([("async-a-b", level), ("setup-message-broker", "low"), *extra])


def test_microservices(spark):
    groups = spark.createDataFrame([("r", "a", "a"), ("r", "a", "b")], "repo_id string, seed string, service string")
    endpoints = spark.createDataFrame([("r", "a", "/x"), ("r", "a", "/y"), ("r", "b", "/videos")], "repo_id string, service string, path string")
    got = backlog.microservice_steps(requests(spark, "microservices"), groups, endpoints)
    assert rows(got, "id") == [("api-versioning-a",), ("separate-db-a",), ("setup-service-mesh",)]
    assert backlog.microservice_steps(requests(spark, "microservices", safety="medium"), groups, endpoints).count() == 2
    files = spark.createDataFrame([("r", "a", "a/api.py"), ("r", "a", "a/main.py"), ("r", "b", "b/routes.py")],
                                  "repo_id string, service string, path string")
    assert rows(backlog.step_files(got, files), "step_id", "path") == [("api-versioning-a", "a/api.py")]


def test_generic(spark):
    smells = spark.createDataFrame(
        [("r", "god_service", "a", "Split it"), ("r", "god_service", "b", None), ("r", "high_complexity", "c", ""),
         ("r", "dead_code", "a", "x"), ("r", "dead_code", "b", "y"), ("r", "shared_database", "a", "z")],
        "repo_id string, type string, location string, suggested_fix string")
    got = backlog.generic_steps(requests(spark, "anything"), smells)
    assert rows(got, "id", "description") == [
        ("reduce-complexity-c", "Reduce complexity in c"), ("remove-dead-code", "Remove unused code and dependencies"),
        ("split-god-service-a", "Split it"), ("split-god-service-b", "Split b into smaller services")]


def test_success_criteria(spark):
    for score, more in [(0.3, []), (0.31, ["Coupling score reduced below 0.3 (current: 0.31)"])]:
        metrics = spark.createDataFrame([("r", score)], "repo_id string, coupling_score double")
        got = [r.criterion for r in backlog.success_criteria(requests(spark, "plain"), metrics).orderBy("ordinal").collect()]
        assert got == BASE_CRITERIA + more


def test_duplicate_ids_collapse(spark):
    got = ordering.ordered_steps(steps(spark, ("b", ["a"]), ("a", []), ("b", [])))
    assert [(r.id, r.level, r.ordinal, r.description) for r in ordering.in_order(got).collect()] == [
        ("a", 0, 1, "step a 1"), ("b", 1, 0, "step b 2")]


def test_cycle_keeps_input_order(spark):
    cyclic = steps(spark, ("c", []), ("b", ["a"]), ("a", ["b"]), ("c", []))
    got = ordering.in_order(ordering.ordered_steps(cyclic.unionByName(steps(spark, ("y", ["x"]), ("x", []), plan="q"))))
    assert [(r.plan_id, r.id, r.level) for r in got.collect()] == [
        ("p", "c", None), ("p", "b", None), ("p", "a", None), ("p", "c", None), ("q", "x", 0), ("q", "y", 1)]


def test_wildcards(spark):
    wild = steps(spark, ("z", ["a-*", "none-*", "gone"]), ("a-1", ["a-2"]), ("a-2", []), ("b", ["z"]))
    assert rows(ordering.step_levels(wild), "id", "level") == [("a-1", 1), ("a-2", 0), ("b", 3), ("z", 2)]
    assert rows(ordering.exact_dependencies(wild), "source", "target") == [("a-2", "a-1"), ("z", "b")]
    self_matching = steps(spark, ("a-1", ["a-*"]), ("b", []))
    assert rows(ordering.step_levels(self_matching), "id") == [("b",)]


def test_priorities(spark):
    items = spark.createDataFrame(
        [("p", 0, "api_versioning", "Plain"), ("p", 1, "restructure", "Use the DATABASE"), ("p", 2, "rename", "Nothing"),
         ("p", 3, "database_migration", "api too")], "plan_id string, ordinal int, type string, description string")
    wanted = spark.createDataFrame([("p", ["database", "api", "database"])], "plan_id string, priorities array<string>")
    got = ordering.prioritized_steps(items, wanted)
    # A priority named twice counts with its last place.
    assert rows(got, "priority_rank", "ordinal") == [(1, 0), (2, 1), (2, 3), (3, 2)]
    none = spark.createDataFrame([("p", None)], "plan_id string, priorities array<string>")
    assert rows(ordering.prioritized_steps(items, none), "priority_rank") == [(0,)] * 4


def test_first_steps_and_totals(spark):
    many = steps(spark, *[(f"s{i:02d}", []) for i in range(12)])
    first = ordering.first_steps(ordering.ordered_steps(many))
    assert {(r.position, r.description, r.n_more) for r in first.collect()} == {
        (i + 1, f"step s{i:02d} {i}", 2) for i in range(10)}
    totals = assembly.plan_totals(many).first()
    assert (totals.n_steps, totals.total_effort, totals.high_risk_count, totals.total_risk_score) == (12, 12, 12, 36)


def test_value_checks(spark):
    data = spark.createDataFrame([("restructure", 0.5), ("other", 0.5), ("rename", 1.5)], "type string, strength double")
    assert rows(violations(data, allowed("type"), unit_interval("strength")), "type") == [("other",), ("rename",)]
