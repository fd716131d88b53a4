import random

from helpers import rows
from pyspark.sql import functions as F

from fleetscope.operators import commits, risks
from fleetscope.operators.positions import running_positions

CHANGES = "change_set_id string, ordinal int, file_path string, change_type string, diff string, line_changes map<string,int>, semantic_changes array<string>"
STEPS = ("plan_id string, ordinal int, id string, change_set_id string, type string, description string, risk_level string, "
         "rollback_strategy string, validation_steps array<string>, commit_message string")
RISKS = ("change_set_id string, ordinal int, stage int, sub_ordinal int, rule_id string, type string, severity string, "
         "description string, subject string, component string")


def changes(spark, *paths, kind="modify", added=10, removed=5):
    return spark.createDataFrame(
        [("c", i, p, kind, "", {"added": added, "removed": removed}, [f"Touched {p}"]) for i, p in enumerate(paths)], CHANGES)


def step(spark, description="Add tracking numbers to parcel service", type_="api_versioning", message=None, risk="medium",
         rollback=None, checks=()):
    return spark.createDataFrame([("p", 0, "move-7", "c", type_, description, risk, rollback, list(checks), message)], STEPS)


def one_risk(spark, severity="high"):
    return spark.createDataFrame([("c", 0, 1, 0, "R02", "api_change", severity, "API endpoints modified", None, "depot/tracking.py")], RISKS)


def no_risk(spark):
    return spark.createDataFrame([], RISKS)


def test_commit_record(spark):
    edited = changes(spark, "depot/tracking.py", "depot/parcels.py")
    got = commits.commit_records(step(spark, checks=["a", "b", "c", "d"]), edited, one_risk(spark))
    row = got.withColumn("full", commits.full_message()).withColumn("ok", commits.passes_gate()).first()
    assert (row.type, row.scope, row.breaking_change) == ("feat", "depot", True)
    assert row.message == "feat(depot): tracking numbers to parcel service"
    assert row.body == (
        "- Add tracking numbers to parcel service\n\nChanges:\n- Modified 2 files (+20/-10 lines)\n- Touched depot/parcels.py\n"
        "- Touched depot/tracking.py\n\nValidation:\n- a\n- b\n- c\n\nRisks addressed:\n- api_change: API endpoints modified")
    assert row.footer == (
        "BREAKING CHANGE: API modifications may affect existing clients\n  - API endpoints modified\n\nRef: move-7")
    assert row.full == f"{row.message}\n\n{row.body}\n\n{row.footer}" and row.ok


def headers(spark, data):
    table = spark.createDataFrame(data, "description string, kind string, scope string")
    return table.withColumn("h", commits.header(F.col("description"), F.lit(None).cast("string"), F.col("kind"), F.col("scope"))).collect()


def test_short_and_single_headers(spark):
    cases = {
        ("Add parcel tracking", "feat", None): "feat: parcel tracking",
        ("Fix depot lookup", "fix", "depot"): "fix(depot): depot lookup",
        ("Additional depots", "feat", None): "feat: additional depots",
        ("x" * 80 + " b c d e", "feat", None): "feat: " + "x" * 80 + " b c...",
    }
    for row in headers(spark, list(cases)):
        assert row.h == cases[row.description, row.kind, row.scope]


def test_long_headers_keep_the_longest_fitting_words(spark):
    dice = random.Random(5)
    data = []
    for _ in range(400):
        words = ["".join(dice.choice("zqé") for _ in range(dice.randint(1, 18))) for _ in range(dice.randint(1, 14))]
        data.append((" ".join(words), dice.choice(["feat", "refactor"]), dice.choice(["depot", "parcel-service"])))
    for row in headers(spark, data):
        start = f"{row.kind}({row.scope}): "
        if len(start + row.description) <= 72:
            assert row.h == start + row.description
            continue
        assert row.h.startswith(start) and row.h.endswith("...")
        kept, every = row.h[len(start):-3].split(" "), row.description.split(" ")
        assert kept == every[: len(kept)] and len(kept) >= min(3, len(every))
        if len(kept) > 3:
            assert len(start + " ".join(kept)) <= 72
        if len(kept) < len(every):
            assert len(start + " ".join(every[: len(kept) + 1])) > 72


def test_types(spark):
    cases = [("Move it", "database_migration", "feat"), ("Move it", "remove_dead_code", "chore"), ("Move it", "restructure", "refactor"),
             ("Move it", "unknown", "refactor"), ("Address it", "restructure", "feat"), ("Optimize it", "restructure", "refactor"),
             ("Inspect it", "restructure", "test"), ("Efficiency", "restructure", "perf"), ("Precise", "restructure", "ci")]
    table = spark.createDataFrame(cases, "description string, type string, expected string")
    got = table.withColumn("kind", commits.commit_type(F.col("description"), F.col("type")))
    assert got.filter("kind <> expected").count() == 0


def scope_of(spark, *paths):
    return commits.change_set_summary(changes(spark, *paths)).select(commits.scope().alias("s")).first().s


def test_scopes(spark):
    assert scope_of(spark, "a/b/x.py", "a/b/y.py") == "b"
    assert scope_of(spark, "src/x.py", "src/user_service.py") == "src"
    assert scope_of(spark, "src/x.py", "src/service_auth.py") == "service-auth"
    assert scope_of(spark, "src/x.py") is None
    assert scope_of(spark, "x.py", "y.py") is None
    assert scope_of(spark, "lib/a/x.py", "lib/b/y.py") == "lib"
    assert scope_of(spark, "lib/a/x.py", "y.py") == "lib"
    assert scope_of(spark, "a/x.py", "b/y.py") is None
    assert scope_of(spark, "./a//x.py", "a/y.py") == "a"
    assert scope_of(spark, "a/x.py", "b/api-v2/y.py", "c/workers/z.py") == "api-v2"


def test_gate_and_results(spark):
    for added, ok in [(995, True), (996, False)]:
        edited = changes(spark, "api/a.py", added=added, removed=5)
        records = commits.commit_records(step(spark), edited, no_risk(spark))
        result = commits.step_results(step(spark), records, no_risk(spark)).first()
        assert result.success is ok
        assert result.error == (None if ok else "Failed to commit: Commit verification failed")
    custom = commits.commit_records(step(spark, message="not conventional"), changes(spark, "api/a.py"), no_risk(spark))
    assert not custom.select(commits.passes_gate().alias("ok")).first().ok
    untouched = commits.step_results(step(spark), custom.limit(0), one_risk(spark, "critical")).first()
    assert (untouched.success, untouched.n_changes, untouched.n_risks, untouched.n_severe_risks) == (True, 0, 1, 1)


def test_body_and_footer_parts(spark):
    quiet = commits.commit_records(
        step(spark, "Same", message="Same", risk="high", rollback="undo"), changes(spark, "a/x.py", kind="rename"), no_risk(spark)).first()
    assert quiet.message == "Same"
    assert quiet.body == "\nChanges:\n- Renamed 1 files\n- Touched a/x.py"
    assert quiet.footer == "\nRef: move-7\n\nRollback: undo"
    assert quiet.breaking_change is False


def test_progress_stops_at_the_first_failure(spark):
    results = spark.createDataFrame(
        [("p", i, f"s{i}", i != 2, 0) for i in range(4)] + [("q", 0, "t", True, 1)],
        "plan_id string, ordinal int, step_id string, success boolean, n_severe_risks long")
    assert rows(commits.execution_progress(results), "step_id", "position", "total", "percent") == [
        ("s0", 1, 4, 25.0), ("s1", 2, 4, 50.0), ("t", 1, 1, 100.0)]
    assert rows(commits.execution_summary(results), "plan_id", "n_succeeded", "n_steps") == [("p", 2, 3), ("q", 1, 1)]
    assert rows(commits.executed(results), "step_id") == [("s0",), ("s1",), ("s2",), ("t",)]


def test_running_positions_over_chunks(spark):
    data = [("a", i * 3) for i in range(50)] + [("b", 7)]
    got = running_positions(spark.createDataFrame(data, "k string, o int"), "k", "o", chunk=8)
    assert rows(got, "k", "o", "position", "total") == sorted(
        [("a", i * 3, i + 1, 50) for i in range(50)] + [("b", 7, 1, 1)], key=repr)


def test_release_tables(spark):
    edited = changes(spark, "api/a.py")
    records = commits.commit_records(step(spark, "Same", message="Same"), edited, one_risk(spark))
    results = commits.step_results(step(spark, "Same", message="Same"), records, one_risk(spark))
    assert commits.release_commits(records, results).isEmpty()  # the gate refuses this header
    passed = results.withColumn("success", F.lit(True))
    assert commits.release_commits(records, passed).first().body_head == "Changes:\n- Modified 1 files (+10/-5 lines)"
    top = commits.release_risks(step(spark), one_risk(spark)).first()
    assert top.mitigation == "Ensure backward compatibility or version the API"
    assert rows(commits.first_test_suggestions(step(spark), one_risk(spark), limit=2), "position", "suggestion") == [
        (1, "Test with existing API clients"), (2, "Update API tests")]
    report = commits.severity_report(step(spark), one_risk(spark)).first()
    assert (report.severity, report.severity_rank, report.n_risks) == ("high", 2, 1)
    assert commits.severity_report(step(spark), no_risk(spark)).first().n_risks == 0
    impact = commits.commit_impact(records, edited.union(edited)).first()
    assert (impact.files_changed, impact.lines_added, impact.lines_removed) == (1, 20, 10)


def test_most_urgent_risks_first(spark):
    data = [("c", i, 1, 0, "R02", "api_change", s, f"d{i}", None, "f") for i, s in enumerate(["high", "medium", "critical", "high", "high"])]
    found = spark.createDataFrame(data, RISKS)
    row = commits.commit_records(step(spark), changes(spark, "a/x.py"), found).first()
    assert row.body.endswith("Risks addressed:\n- api_change: d2\n- api_change: d0\n- api_change: d3")
    assert "\n  - d2\n  - d0\n" in row.footer
    assert rows(risks.first_risks(found, ["change_set_id"], 2), "position", "description") == [(1, "d2"), (2, "d0")]
