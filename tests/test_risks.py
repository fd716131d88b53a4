from helpers import rows

from fleetscope.operators import risks

CHANGES = "change_set_id string, ordinal int, file_path string, change_type string, diff string"


def changes(spark, *diffs, kind="modify"):
    return spark.createDataFrame([("c", i, f"f{i}.py", kind, d) for i, d in enumerate(diffs)], CHANGES)


def fired(spark, diff, kind="modify"):
    found = risks.change_risks(changes(spark, diff, kind=kind)).collect()
    return sorted((r.rule_id, r.severity) for r in found)


def test_route_moved(spark):
    assert fired(spark, '-@app.route("/parcels")\n+@app.route("/parcels/track")') == [("R02", "high")]


def test_route_removed(spark):
    found = risks.change_risks(changes(spark, "-   @app.get('/x')  \n-@app.get('/y')")).collect()
    # The decorator is also a call on `app`: two route families see it.
    assert sorted((r.rule_id, r.sub_ordinal, r.description) for r in found) == [
        ("R01", 1, "API endpoint removed: @app.get('/x')"), ("R01", 3, "API endpoint removed: @app.get('/x')")]
    assert risks.distinct_risks(found_frame(spark, found)).count() == 1


def found_frame(spark, found):
    schema = ("change_set_id string, ordinal int, stage int, sub_ordinal int, rule_id string, type string, severity string, "
              "description string, subject string, component string")
    return spark.createDataFrame([tuple(r) for r in found], schema).selectExpr("*", "1L AS n_components")


def test_changed_condition(spark):
    diff = "-if weight > limit:\n+if weight >= limit and not parcel.waived:\n     reject(parcel)\n"
    assert fired(spark, diff) == [("R04", "high")]


def test_sql_f_string(spark):
    assert ("R10b", "critical") in fired(spark, '+cursor.execute(f"DELETE FROM parcels WHERE depot = {depot}")')
    assert "R10b" not in {rule for rule, _ in fired(spark, '+cursor.execute("DELETE FROM parcels WHERE depot = ?")')}


def test_sql_building(spark):
    assert ("R10", "critical") in fired(spark, '+q = "a" + "select 1"')
    assert ("R10", "critical") in fired(spark, "+q = '{}'.format(x) or 'DELETE'")
    assert ("R10", "critical") in fired(spark, "+q = '%(a)s' % (x) + update")
    # The statement must follow on the same line.
    assert fired(spark, "+q = a + b\n+r = 'UPDATE'") == [("R08", "high")]


def test_loops(spark):
    assert fired(spark, "+for shelf in depot:\n+    for box in shelf:\n+        weigh(box)\n") == [("R07", "medium")]


def test_headers_are_not_lines(spark):
    assert fired(spark, "--- return a\n+++ return b\n return c") == []
    # A removed line that itself starts with two dashes looks like a header.
    assert rows(risks.diff_lines(changes(spark, "---comment\n--x\n+y\n++z")), "side", "position", "line") == [
        ("+", 0, "y"), ("+", 1, "+z"), ("-", 0, "-x")]


def test_auth_secret_async_exception(spark):
    assert fired(spark, "-@login_required") == [("R11", "critical")]
    assert fired(spark, "-@login_required\n+@requires_auth") == []
    assert fired(spark, "+API_KEY = 'abc'") == [("R12", "critical")]
    assert fired(spark, '+aws_secret_x="q"') == [("R12", "critical")]
    assert fired(spark, "+key = ''") == []
    assert fired(spark, "+async def f():\n+    open(x)") == [("R09", "high")]
    assert fired(spark, " async def f():\n+    open(x)") == []
    assert fired(spark, "-    try:") == [("R06", "medium")]


def test_add_and_rename(spark):
    assert fired(spark, "+import os\n+return x", kind="add") == [("R13", "low")]
    assert fired(spark, "+x", kind="add") == []
    assert fired(spark, "+import os", kind="rename") == [("R14", "medium")]
    assert fired(spark, "-@login_required", kind="delete") == [("R11", "critical")]


def test_parameters(spark):
    diff = "-def f(a, b):\n-def g(a):\n-def f(x):\n+def f( x , y=1):\n+def g(a ):\n+def h():\n-def k(a, b):\n+def k(b):"
    assert rows(risks.parameter_changes(changes(spark, diff)), "function", "removed_params", "added_params") == [
        ("f", [], ["y=1"]), ("k", ["a"], [])]
    assert fired(spark, diff) == [("R03", "high"), ("R03", "medium")]
    assert fired(spark, "-def helper():\n+def helper_function():") == []


def test_unicode_lines(spark):
    assert rows(risks.parameter_changes(changes(spark, "-def é(a):\n+def é(b):")), "function") == [("é",)]
    assert fired(spark, "+tok\u2028en\u00a0=\u00a0'x'") == []
    assert fired(spark, "+token\u00a0=\u00a0'x'") == [("R12", "critical")]


def test_change_set_thresholds(spark):
    ten = changes(spark, *["+x"] * 10)
    eleven = changes(spark, *["+x"] * 11)
    assert risks.change_set_risks(ten).count() == 0
    assert rows(risks.change_set_risks(eleven), "rule_id", "n_components") == [("R16", 11)]
    assert risks.first_changed_files(ten).count() == 0
    assert risks.first_changed_files(eleven).first().affected_components == [
        "f0.py", "f1.py", "f2.py", "f3.py", "f4.py", "..."]
    two = changes(spark, " class A:", " trait B:", "+x")
    assert rows(risks.change_set_risks(two), "rule_id", "n_components") == [("R15", 2)]
    assert rows(risks.interface_components(two), "file_path") == [("f0.py",), ("f1.py",)]
    assert risks.change_set_risks(changes(spark, " class A:", "+x")).count() == 0


def test_priority_order(spark):
    two = spark.createDataFrame(
        [("c", 0, "utils.py", "modify", "-def helper():\n+def helper_function():"), ("c", 1, "auth.py", "modify", "-@login_required"),
         ("c", 2, "z.py", "rename", ""), ("c", 3, "a.py", "modify", "+    for x in y:")], CHANGES)
    got = [(r.rule_id, r.priority) for r in risks.regression_risks(two).collect()]
    assert got == [("R11", 44), ("R14", 23), ("R07", 21)]


def test_first_of_equal_risks_wins(spark):
    same = spark.createDataFrame(
        [("c", 1, "a.py", "modify", "-def f(x):\n+def f(y):"), ("c", 0, "a.py", "modify", "-def f():\n+def f(y):")], CHANGES)
    got = risks.regression_risks(same).collect()
    assert [(r.rule_id, r.severity, r.ordinal) for r in got] == [("R03", "medium", 0)]
    guided = risks.with_guidance(risks.regression_risks(same)).first()
    assert guided.test_suggestions[0] == "Test all calls to f"
    assert guided.mitigation == "Update all callers or maintain backward compatibility"
