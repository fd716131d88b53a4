import datetime

from helpers import rows

from fleetscope.operators.risks import change_risks
from fleetscope.schemas import CHANGES
from fleetscope.sources import tables
from fleetscope.streaming.risk_stream import write_risk_stream


def test_changes_round_trip(spark, tmp_path):
    data = [("c", 0, "a.py", "modify", "-x", {"added": 1}, ["s"])]
    spark.createDataFrame(data, CHANGES).write.json(str(tmp_path / "in"))
    got = tables.read_changes(spark, str(tmp_path / "in"), "json").first()
    assert got.line_changes == {"added": 1} and got.semantic_changes == ["s"]


def test_analysis_and_results_append(spark, tmp_path):
    metrics = spark.createDataFrame([("r", 1)], "repo_id string, n int")
    for run in ["20260101-000000", "20260102-000000"]:
        tables.write_analysis({"metrics": metrics, "smells": metrics}, str(tmp_path), run, "json")
        tables.write_results(metrics, str(tmp_path), run)
    assert spark.read.json(str(tmp_path / "metrics")).count() == 2
    assert spark.read.parquet(str(tmp_path / "results")).count() == 2


def test_plans_read_their_latest_run(spark, tmp_path):
    schema = "plan_id string, n_steps int"
    tables.write_plans(spark.createDataFrame([("p", 1), ("q", 5)], schema), str(tmp_path), "20260101-000000")
    tables.write_plans(spark.createDataFrame([("p", 2)], schema), str(tmp_path), "20260102-000000")
    assert rows(tables.read_plans(spark, str(tmp_path)), "plan_id", "n_steps") == [("p", 2), ("q", 5)]


def test_ledger(spark, tmp_path):
    schema = "plan_id string, step_id string, commit_id string, timestamp timestamp, message string"
    path = str(tmp_path / "ledger")
    early, late = datetime.datetime(2026, 1, 1), datetime.datetime(2026, 1, 2)
    tables.append_ledger(spark.createDataFrame([("p", "s", "c1", early, "m1"), ("p", "t", "c2", early, "m2")], schema), path)
    tables.append_ledger(spark.createDataFrame([("p", "s", "c3", late, "m3")], schema), path)
    ledger = tables.read_ledger(spark, path)
    assert ledger.count() == 3
    assert rows(tables.ledger_state(ledger), "step_id", "commit_id", "message") == [("s", "c3", "m3"), ("t", "c2", "m2")]


def test_a_repeated_run_leaves_its_rows_once(spark, tmp_path):
    first = spark.createDataFrame([("r", 1), ("s", 2)], "repo_id string, n int")
    for table, run in [(first, "20260101-000000"), (first, "20260102-000000"), (first.limit(1), "20260101-000000")]:
        tables.write_results(table, str(tmp_path), run)
    got = spark.read.parquet(str(tmp_path / "results")).groupBy("run_ts").count()
    assert rows(got) == [("20260101-000000", 1), ("20260102-000000", 2)]


def test_ledger_entries_are_added_once(spark, tmp_path):
    schema = "plan_id string, step_id string, commit_id string, timestamp timestamp, message string"
    path, at = str(tmp_path / "ledger"), datetime.datetime(2026, 1, 1)
    first = [("p", "s", "c1", at, "m"), ("p", None, "c2", None, None), ("p", "s", "c1", at, "m")]
    tables.append_ledger(spark.createDataFrame(first, schema), path)
    tables.append_ledger(spark.createDataFrame([*first, ("p", "s", "c3", at, "m")], schema), path)
    assert rows(tables.read_ledger(spark, path), "commit_id") == [("c1",), ("c2",), ("c3",)]


def test_stream_equals_batch(spark, tmp_path):
    data = [("c", i, f"f{i}.py", "modify", d, {}, []) for i, d in enumerate(["-@login_required", "+key = 'a'", "+x", "-def f(a):\n+def f(b):"])]
    batch = spark.createDataFrame(data, CHANGES)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in"))
    query = write_risk_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    names = ["ordinal", "rule_id", "severity", "description", "component"]
    assert rows(got, *names) == rows(change_risks(batch), *names)
