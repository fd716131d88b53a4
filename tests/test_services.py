import pytest
from helpers import rows
from pyspark.sql import functions as F

from fleetscope.operators import dependencies, facts, rollups, smells
from fleetscope.sources import files as sources

FILES = "repo_id string, service string, path string, content string"
STOCK = (
    "import redis\nfrom fastapi import APIRouter\nrouter = APIRouter()\ncache = redis.Redis()\n"
    "@router.get('/v2/stock')\ndef listed(limit, offset):\n    return cache.get('SELECT name FROM shelves')\n"
)
STOCK_JOBS = "def refill(rows):\n    for row in rows:\n        while row:\n            row = None\n"
SHIPPING = (
    "import requests\n@app.post('/parcels')\ndef send(order):\n    left = requests.get('http://stock.local/v2/stock/17')\n"
    "    requests.put('http://stock.local/v2/reserve')\n    return left\n"
)


def wide(n):
    """A module of ``n`` routes, their verbs in turn."""
    verbs = ["get", "post", "delete"]
    return "\n".join(f"@app.{verbs[k % 3]}('/report/{k}')\ndef report_{k}(day): pass" for k in range(n))


def tree(spark, extra=()):
    data = [("shop", "stock", "stock/api/routes.py", STOCK), ("shop", "stock", "stock/jobs/nightly/refill.py", STOCK_JOBS),
            ("shop", "shipping", "shipping/app.py", SHIPPING), *extra]
    return spark.createDataFrame(data, FILES)


def test_services_of_several_files_and_frameworks(spark):
    reports = [("shop", f"reports{n}", f"reports{n}/app.py", wide(n)) for n in (20, 21)]
    found = facts.file_facts(tree(spark, reports)).cache()
    rolled = rollups.service_rollup(found)
    assert rows(rolled, "service", "n_files", "complexity", "n_endpoints", "n_tables", "n_external_dependencies") == [
        ("reports20", 1, 1, 20, 0, 0), ("reports21", 1, 1, 21, 0, 0), ("shipping", 1, 1, 1, 0, 1), ("stock", 2, 4, 1, 1, 1)]
    assert rows(smells.service_smells(rolled), "type", "location") == [("god_service", "reports21")]
    # Of the two paths that shipping calls, stock declares one; the other, /v2/reserve, is nobody's.
    assert rows(dependencies.endpoint_dependencies(facts.endpoints(found), found), "source", "target", "path") == [("shipping", "stock", "/v2/stock")]


def test_god_service_and_complexity_thresholds(spark):
    rolled = spark.createDataFrame(
        [("r", "a", 1, 10, 20, 0, 0), ("r", "b", 1, 11, 21, 0, 0), ("r", "c", 100, 1001, 0, 1, 0), ("r", "d", 0, 0, 0, 2, 0)],
        "repo_id string, service string, n_files long, complexity long, n_endpoints long, n_tables long, "
        "n_external_dependencies long")
    assert rows(smells.service_smells(rolled), "type", "location", "description") == [
        ("god_service", "b", "Service has 21 endpoints, consider splitting"),
        ("high_complexity", "b", "Average file complexity is 11.0"),
        ("high_complexity", "c", "Average file complexity is 10.0")]
    assert rows(smells.over_complex_services(rolled), "service") == [("c",)]
    assert smells.database_advice(rolled).first().services_with_tables == 2


def test_services_without_files_keep_zeros(spark):
    listed = spark.createDataFrame([("shop", "shipping"), ("shop", "empty")], "repo_id string, service string")
    rolled = rollups.service_rollup(facts.file_facts(tree(spark)), listed)
    assert rows(rolled, "service", "n_files", "complexity") == [("empty", 0, 0), ("shipping", 1, 1)]


def mentions(spark, declared, code):
    data = [("r", "a", "a.py", "\n".join(f"@app.get('{p}')\ndef f{i}(): pass" for i, p in enumerate(declared))),
            ("r", "b", "b.py", code)]
    found = facts.file_facts(spark.createDataFrame(data, FILES)).cache()
    deps = dependencies.endpoint_dependencies(facts.endpoints(found), found)
    return rows(deps, "source", "target", "path", "declarations")


def test_mentions_are_whole_segments(spark):
    declared = ["/api/users", "/api/user", "/users/all", "/", "/v/", "plain/x"]
    got = mentions(spark, declared, "get('http://h/api/users/all?x=1')\nu = '/v/'\nw = 'http://h/plain/x'\n")
    assert got == [("b", "a", "/api/users", 1), ("b", "a", "/users/all", 1), ("b", "a", "/v/", 1), ("b", "a", "plain/x", 1)]


def test_a_declaration_is_no_call(spark):
    data = [("r", s, f"{s}.py", "@app.get('/health')\ndef up(): pass\n") for s in "abcde"]
    found = facts.file_facts(spark.createDataFrame(data, FILES)).cache()
    assert dependencies.endpoint_dependencies(facts.endpoints(found), found).isEmpty()
    data.append(("r", "f", "f.py", "get('http://h/health')\n"))
    found = facts.file_facts(spark.createDataFrame(data, FILES)).cache()
    assert rows(dependencies.endpoint_dependencies(facts.endpoints(found), found), "source", "target") == [("f", s) for s in "abcde"]


def test_files_that_do_not_parse_still_make_a_service(spark):
    data = [("r", "a", "a.py", "x = 1\n"), ("r", "b", "b.py", "def (\n")]
    found = facts.file_facts(spark.createDataFrame(data, FILES)).cache()
    assert rows(rollups.service_rollup(found, found), "service", "n_files") == [("a", 1), ("b", 0)]


def test_long_paths_are_compared_in_full(spark):
    long = "/" + "/".join(f"s{i}" for i in range(12))
    other = "/" + "/".join(f"s{i}" for i in range(11)) + "/t"
    declared = [long, other, "/s3/s4", "/s5/s6/s7/s8/s9/s10/s11/end", long + "x", "/s3/s4"]
    got = mentions(spark, declared, f"get('http://h/x{long}/end')\n")
    assert got == [("b", "a", long, 1), ("b", "a", "/s3/s4", 2), ("b", "a", "/s5/s6/s7/s8/s9/s10/s11/end", 1)]


def test_centrality_counts_distinct_edges(spark):
    deps = spark.createDataFrame(
        [("r", "a", "b", "/x", 0.7, 2), ("r", "a", "b", "/y", 0.7, 1), ("r", "b", "a", "/z", 0.7, 1), ("r", "c", "b", "/x", 0.7, 2)],
        "repo_id string, source string, target string, path string, strength double, declarations long")
    edges = dependencies.dependency_edges(deps)
    central = dependencies.degree_centrality(edges)
    assert rows(central, "service", "degree", "centrality") == [("a", 2, 1.0), ("b", 3, 1.5), ("c", 1, 0.5)]
    rolled = spark.createDataFrame(
        [("r", s, 1, 3, 1, 0, 0) for s in "abcd"],
        "repo_id string, service string, n_files long, complexity long, n_endpoints long, n_tables long, "
        "n_external_dependencies long")
    metrics = rollups.fleet_metrics(rolled, deps, central).first()
    assert (metrics.total_services, metrics.total_dependencies, metrics.coupling_score) == (4, 6, 0.5)
    assert metrics.max_centrality == 1.5
    onto = dependencies.dependents(rolled, deps)
    areas = smells.risk_areas(central, rolled, onto)
    assert rows(areas, "type", "service", "description") == [
        ("high_coupling", "a", "a is highly coupled with 4 other services"),
        ("high_coupling", "b", "b is highly coupled with 6 other services"),
        ("single_point_of_failure", "b", "b is a dependency for 5 services")]


def test_unversioned_means_no_slash_v(spark):
    declared = spark.createDataFrame(
        [("r", "s", "f", i, p) for i, p in enumerate(["/videos", "/v1/a", "/a", "/b", "/c", "/d", "/e", "/f"])],
        "repo_id string, service string, file_path string, ordinal int, path string")
    assert smells.unversioned_endpoints(declared).count() == 6
    first = smells.first_unversioned(declared)
    assert rows(first, "position", "endpoint") == [(1, "s:/a"), (2, "s:/b"), (3, "s:/c"), (4, "s:/d"), (5, "s:/e")]


def test_shared_tables(spark):
    tables = spark.createDataFrame([("r", "a", "t"), ("r", "b", "t"), ("r", "b", "u"), ("q", "c", "u")],
                                   "repo_id string, service string, table string")
    shared = dependencies.shared_tables(tables)
    assert rows(shared, "repo_id", "table", "service", "n_services") == [("r", "t", "a", 2), ("r", "t", "b", 2)]
    assert smells.shared_database_smells(shared).count() == 2


def test_discovery(spark):
    paths = [
        "services/auth-service/main.py", "services/README.py", "apps/.hidden/x.py", "src/services/pay-api/a/b.js",
        "auth-service/x.py", "mail-worker/y.js", "docs-api/readme.md", "microservices/auth/z.py", "auth-api/x.py",
        "lib/services/no/x.py",
    ]
    found = sources.discover_services(spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string"))
    assert rows(found, "service", "svc_path") == [
        ("auth", "auth-api"), ("mail-worker", "mail-worker"), ("pay", "src/services/pay-api")]


def test_map_and_requests(spark):
    facts_ = spark.createDataFrame([("r", "a/b/x.py", None, 1), ("r", "ab/y.py", "bad", None)],
                                   "repo_id string, path string, error string, complexity int")
    mapping = spark.createDataFrame([("r", "one", "a"), ("r", "two", "a/b/"), ("r", "none", "b")],
                                    "repo_id string, service string, svc_path string")
    assert rows(sources.assign_services(facts_, mapping), "path", "service") == [("a/b/x.py", "one"), ("a/b/x.py", "two")]
    wanted = spark.createDataFrame([("r", "a/b/x.py"), ("r", "ab/y.py"), ("r", "gone.py")], "repo_id string, path string")
    assert rows(sources.requested_files(wanted, facts_), "path", "error") == [
        ("a/b/x.py", None), ("ab/y.py", "Syntax error in ab/y.py: bad"), ("gone.py", "File not found: gone.py")]


@pytest.mark.parametrize("bound", [0, 10])
def test_only_requested_files_are_parsed(spark, bound):
    asked = ["shipping/app.py", "shipping/app.py", "gone.py", "bad.py", None]
    wanted = spark.createDataFrame([("shop", p) for p in asked], "repo_id string, path string")
    files = tree(spark, [("shop", "x", "bad.py", "def ("), ("other", "x", "gone.py", "y = 1\n"), ("shop", "x", None, "y = 1\n")])
    got = sources.requested_file_facts(wanted, files, bound)
    reason = F.regexp_extract("error", "^[^:]*: [a-z]*[.]py|^[^:]*", 0).alias("reason")
    assert rows(got.select("path", reason, "complexity")) == [
        ("bad.py", "Syntax error in bad.py", None), ("gone.py", "File not found: gone.py", None),
        ("shipping/app.py", None, 1), ("shipping/app.py", None, 1), (None, None, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # The texts are chosen below the parser.
    assert plan.index("ArrowEvalPython") < plan.index("LeftSemi")
    assert ("strategy=broadcast" in plan) == (bound > 0)
