"""Views that read the driver tables as code-fleet tables.

The driver tables hold no source code, so each view computes it from their
columns. The SQL text is the same in Spark and DuckDB. About a third of all
changes fall in one change set and a third of all files in one service per
repository, so the queries run over hot keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fleetscope.catalogue import STEP_TYPES

_NL = "chr(10)"


def _text(*lines: tuple[str, str | None]) -> str:
    parts = [line if cond is None else f"CASE WHEN {cond} THEN {line} END" for line, cond in lines]
    return f"concat_ws({_NL}, " + ", ".join(parts) + ")"


def _s(column: str) -> str:
    return f"CAST({column} AS STRING)"


# --- changes, from events ---------------------------------------------------

_DIFF = _text(
    ("'--- a/m.py'", None),
    ("'+++ b/m.py'", None),
    ("'-@app.route(\"/api/v1/u' || " + _s("event_id % 5") + " || '\")'", "event_id % 3 = 0"),
    ("'-  @app.get(\"/api/u' || " + _s("event_id % 4") + " || '\")  '", "event_id % 27 = 1"),
    ("'+@app.route(\"/api/v2/u' || " + _s("event_id % 5") + " || '\")'", "event_id % 6 = 0"),
    ("'+path(\"users\", view)'", "event_id % 37 = 0"),
    ("'-path(\"users\", view)'", "event_id % 41 = 0"),
    ("'-def f' || " + _s("event_id % 5") + " || '(a, b):'", "event_id % 4 = 0"),
    ("'-def g(a):'", "event_id % 12 = 0"),
    ("'+def f' || " + _s("event_id % 5") + " || '(a, c, d):'", "event_id % 8 = 0"),
    ("'+def g( a , b=1 ):'", "event_id % 24 = 0"),
    ("'+def f' || " + _s("event_id % 5") + " || '(a, b):'", "event_id % 16 = 0"),
    ("'-    if a > 1:'", "event_id % 5 = 0"),
    ("'+    if a > 2:'", "event_id % 10 = 0"),
    ("'+    for x in b:'", "event_id % 7 = 0"),
    ("'-    while a:'", "event_id % 14 = 0"),
    ("'-    return a'", "event_id % 9 = 0"),
    ("'+    return a'", "event_id % 18 = 0"),
    ("'+    raise ValueError(a)'", "event_id % 11 = 0"),
    ("'+    q = x + \"SELECT 1\"'", "event_id % 13 = 0"),
    ("'+    q = f\"delete from t where i = {a}\"'", "event_id % 43 = 0"),
    ("'-    q = db.query(a).all()'", "event_id % 26 = 0"),
    ("'-@login_required'", "event_id % 17 = 0"),
    ("'+@requires_auth'", "event_id % 34 = 0"),
    ("'+token = \"abc\"'", "event_id % 19 = 0"),
    ("'+aws_key_id = ' || chr(39) || 'k' || chr(39)", "event_id % 47 = 0"),
    ("'+async def k():'", "event_id % 23 = 0"),
    ("'+    return requests.get(a)'", "event_id % 46 = 0"),
    ("'--- note'", "event_id % 2 = 0"),
    ("' class A:'", "event_id % 29 = 0"),
    ("'+import os'", "event_id % 31 = 0"),
    ("' unchanged'", None),
)

_CHANGE_SET = "CASE WHEN event_id % 3 = 0 THEN 'c0' ELSE 'c' || " + _s("user_id * 8 + event_id % 8 + 1") + " END"
_CHANGE_PATH = (
    "CASE WHEN event_id % 3 > 0 AND (user_id + event_id % 8) % 4 = 0 THEN 'svc' || " + _s("user_id % 12")
    + " || '/mod' || " + _s("event_id % 40") + " || '.py'"
    + " WHEN event_id % 3 > 0 AND (user_id + event_id % 8) % 4 = 1 THEN 'src/' || "
    + "CASE WHEN event_id % 5 = 0 THEN 'x/user_service' ELSE 'lib' END || '/m' || " + _s("event_id % 40") + " || '.py'"
    + " WHEN event_id % 3 > 0 AND (user_id + event_id % 8) % 4 = 2 THEN 'main' || " + _s("event_id % 9") + " || '.py'"
    + " ELSE 'svc' || " + _s("event_id % 12") + " || '/mod' || " + _s("event_id % 40") + " || '.py' END"
)
_CHANGE_TYPE = (
    "CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'rename' "
    "ELSE 'modify' END"
)

# --- source files, from lineitem ---------------------------------------------

_REPO = "'repo' || " + _s("CAST(floor(l_suppkey / 20) AS BIGINT)")
# Service 20 holds only files that do not parse.
_SVC = "CASE WHEN l_orderkey % 303 = 0 THEN 20 WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey % 20 END"

CONTENT_LINES = [
    ("'import requests'", "k % 2 = 0"),
    ("'import os.path as p, sys'", "k % 5 = 0"),
    ("'from flask import Flask, jsonify as j'", "k % 7 = 0"),
    ("'from . import util'", "k % 11 = 0"),
    ("'@app.' || CASE n % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'post' ELSE 'route' END || '(\"' || "
     "CASE WHEN p % 2 = 0 THEN '/v1' ELSE '' END || '/p/' || CAST(svc AS STRING) || '/' || "
     "CAST(p % 50 AS STRING) || '\")'", "k % (40 + 8 * svc) = 0"),
    ("'@router.delete(\"/v2/q/' || CAST(p % 40 AS STRING) || '\")'", "k % 180 = 1"),
    ("'@api.resource(\"/r/' || CAST(p % 30 AS STRING) || '\")'", "k % 240 = 2"),
    # A route that services of all kinds declare and one service calls.
    ("'@app.get(\"/v1/health\")'", "k % 200 = 4"),
    ("'def h(a, b=1, *args, c=2) -> m.T:'", None),
    ("'    x = \"SELECT x FROM ' || CASE WHEN svc % 5 = 4 THEN 'solo' || CAST(svc AS STRING) "
     "ELSE 't' || CAST(svc + p % 2 AS STRING) END || '\"'", "k % 20 = 1"),
    ("'    y = \"delete  a from shared\"'", "k % 40 = 3 AND svc % 7 = 2"),
    ("'    db.session.query(a)'", "k % 15 = 0"),
    ("'    User.objects.filter(a)'", "k % 25 = 0"),
    ("'    requests.get(\"http://h/v1/p/' || CAST(p % 20 AS STRING) || '/' || CAST(k % 50 AS STRING) || '/x\")'",
     "k % 30 = 0"),
    ("'    requests.get(\"http://h/v1/health\")'", "k % 30 = 10 AND svc = 3"),
    ("'    redis.Redis(a)'", "k % 35 = 0"),
    ("'    if a and b or x:'", "n % 2 = 0"),
    ("'    while a:'", "n % 2 = 1"),
    ("'        pass'", None),
    ("'    def inner(c):'", "k % 9 = 0"),
    ("'        for i in c:'", "k % 9 = 0"),
    ("'            pass'", "k % 9 = 0"),
    ("'@reg.add'", "k % 16 = 0"),
    ("'class C' || CAST(p % 5 AS STRING) || '(Base, m.Mixin, f()):'", "k % 8 = 0"),
    ("'    @prop'", "k % 8 = 0"),
    ("'    def m1(self):'", "k % 8 = 0"),
    ("'        pass'", "k % 8 = 0"),
    ("'    async def m2(self):'", "k % 8 = 0"),
    ("'        pass'", "k % 8 = 0"),
    ("'def broken('", "k % 101 = 0"),
]
_CONTENT = _text(*CONTENT_LINES)

# --- steps, from part ----------------------------------------------------------

_STEP_TYPE = "CASE p_size % 10 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(STEP_TYPES)) + " END"

VIEWS = {
    "code_changes": f"""
SELECT {_CHANGE_SET} AS change_set_id, CAST(event_id AS BIGINT) AS ordinal, {_CHANGE_PATH} AS file_path,
       {_CHANGE_TYPE} AS change_type, {_DIFF} AS diff,
       CAST(event_id % 7 AS INT) AS n_added, CAST(event_id % 5 AS INT) AS n_removed,
       CASE WHEN event_id % 4 > 0 THEN 'Touched part ' || {_s("event_id % 9")} END AS semantic_change
FROM events""",
    # Whole documents as added lines of one change each.
    "text_changes": """
SELECT source AS change_set_id, CAST(doc_id AS BIGINT) AS ordinal, lang || '/' || CAST(doc_id AS STRING) AS file_path,
       'modify' AS change_type, '+' || replace(text, chr(10), chr(10) || '+') AS diff
FROM documents""",
    # Whole documents, each closed by a query on its source.
    "text_files": """
SELECT source AS repo_id, CAST(doc_id AS STRING) AS path,
       text || chr(10) || 'Select ' || lang || ' , x  from ' || source || chr(10) || 'db.session.add (x)' AS content
FROM documents""",
    "file_keys": f"""
SELECT repo_id, 'svc' || CAST(svc AS STRING) AS service, svc, k, n, p,
       'services/svc' || CAST(svc AS STRING) || CASE WHEN n % 3 = 0 THEN '/api' ELSE '' END || '/f'
       || CAST(k AS STRING) || '_' || CAST(n AS STRING) || '_' || CAST(p AS STRING) || '_' || CAST(s AS STRING)
       || '_' || CAST(u AS STRING) || '.py' AS path
FROM (SELECT {_REPO} AS repo_id, {_SVC} AS svc, l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s,
             CAST(floor(l_quantity) AS BIGINT) AS u
      FROM lineitem) AS l""",
    "code_files": f"""
SELECT repo_id, service, path, {_CONTENT} AS content, k AS ordinal_key FROM file_keys""",
    # One step per part; plans of 80 steps, some with duplicate ids, some cyclic.
    "part_keys": """
SELECT CAST(floor(p_partkey / 80) AS BIGINT) AS pl, p_partkey % 80 AS o, p_partkey, p_name, p_size FROM part""",
    "plan_steps": f"""
SELECT 'p' || CAST(pl AS STRING) AS plan_id, CAST(o AS BIGINT) AS ordinal,
       CASE WHEN o = 79 THEN 's20' WHEN o >= 70 THEN 'w' || CAST(o AS STRING) ELSE 's' || CAST(o AS STRING) END AS id,
       {_STEP_TYPE} AS type,
       CASE WHEN o % 6 = 0 THEN 'Add ' WHEN o % 6 = 1 THEN 'Move ' ELSE '' END || p_name AS description,
       concat_ws(',',
         CASE WHEN o BETWEEN 1 AND 69 THEN 's' || CAST(CAST(floor((o - 1) / 2) AS BIGINT) AS STRING) END,
         CASE WHEN o BETWEEN 1 AND 69 THEN 's' || CAST(CAST(floor(o / 3) AS BIGINT) AS STRING) END,
         CASE WHEN o % 13 = 5 THEN 'missing' END,
         CASE WHEN o BETWEEN 60 AND 62 THEN 'w7*' END,
         CASE WHEN o = 2 AND pl % 5 = 3 THEN 's5' END) AS depends_on,
       p_size AS estimated_effort,
       CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS risk_level
FROM part_keys""",
    "ledger": """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'p0' ELSE 'p' || CAST(o_custkey % 97 AS STRING) END AS plan_id,
       's' || CAST(o_custkey % 13 AS STRING) AS step_id, 'c' || CAST(o_orderkey AS STRING) AS commit_id,
       o_orderdate AS made_at, o_orderpriority AS message FROM orders""",
    "plan_priorities": """
SELECT DISTINCT 'p' || CAST(pl AS STRING) AS plan_id,
       CASE pl % 4 WHEN 0 THEN '' WHEN 1 THEN 'ring,database' WHEN 2 THEN 'widget,api,ring,widget'
         ELSE 'dead_code,add ' END AS wanted
FROM part_keys""",
    # Requested files: every file of every third order, and a missing one each.
    "file_requests": """
SELECT repo_id, path FROM code_files WHERE ordinal_key % 3 = 1
UNION ALL
SELECT DISTINCT repo_id, 'gone/f' || CAST(ordinal_key AS STRING) || '.py' AS path
FROM code_files WHERE ordinal_key % 3 = 1""",
    # Paths in every service layout.
    "code_paths": """
SELECT DISTINCT repo_id,
       CASE k % 9 WHEN 0 THEN 'services/s' || t || '-service' WHEN 1 THEN 'microservices/s' || t
         WHEN 2 THEN 'apps/.s' || t WHEN 3 THEN 'src/services/s' || t || '-api' WHEN 4 THEN 's' || t || '-service'
         WHEN 5 THEN 's' || t || '-api' WHEN 6 THEN 's' || t || '-worker' WHEN 7 THEN 'services'
         ELSE 'apps/s' || t END
       || CASE n % 3 WHEN 0 THEN '/a/b' WHEN 1 THEN '/a' ELSE '' END
       || '/m' || CAST(k AS STRING) || CASE n % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.md' ELSE '.py' END
       AS path
FROM (SELECT repo_id, k, n, CAST(p % 23 AS STRING) AS t FROM file_keys) AS f""",
    # Mapped directories, one nested in another.
    "service_map": """
SELECT DISTINCT repo_id, 'team' || CAST(svc % 4 AS STRING) || CASE WHEN svc % 5 = 0 THEN '-api' ELSE '' END AS service,
       'services/svc' || CAST(svc AS STRING) || CASE WHEN svc % 5 = 0 THEN '/api' ELSE '' END AS svc_path
FROM file_keys""",
    # One service graph of 25 nodes per 25 parts.
    "service_edges": """
SELECT DISTINCT repo_id, 'svc' || CAST(x AS STRING) AS source, 'svc' || CAST(y AS STRING) AS target FROM (
  SELECT 'g' || CAST(g AS STRING) AS repo_id, x, (7 * x + g) % 25 AS y
  FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS g, p_partkey % 25 AS x FROM part) AS a
  UNION ALL
  SELECT 'g' || CAST(g AS STRING) AS repo_id, x, (x + 5) % 25 AS y
  FROM (SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS g, p_partkey % 25 AS x FROM part) AS b
  WHERE x % 6 = 0) AS e
WHERE x <> y""",
    # One refactoring step per customer; the change set of the same number, if any.
    "commit_steps": f"""
SELECT 'n' || CAST(c_nationkey AS STRING) AS plan_id, CAST(c_custkey AS BIGINT) AS ordinal,
       'step-' || CAST(c_custkey AS STRING) AS id, 'c' || CAST(c_custkey AS STRING) AS change_set_id,
       CASE c_custkey % 10 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(STEP_TYPES))} END AS type,
       CASE c_custkey % 7 WHEN 0 THEN 'Implement ' WHEN 1 THEN 'fix ' WHEN 2 THEN 'Move ' WHEN 3 THEN 'Update '
         WHEN 4 THEN 'Extract ' WHEN 5 THEN 'Rework ' ELSE 'Split ' END
       || lower(c_mktsegment) || ' module'
       || CASE WHEN c_custkey % 3 = 0 THEN ' so that every caller of the module keeps working during the whole move'
          ELSE '' END AS description,
       CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level,
       CASE WHEN c_custkey % 4 < 2 THEN 'Revert ' || c_name END AS rollback_strategy,
       CASE WHEN c_custkey % 5 > 0 THEN concat_ws(',', 'Check a', 'Check b',
         CASE WHEN c_custkey % 2 = 0 THEN 'Check c' END, CASE WHEN c_custkey % 4 = 0 THEN 'Check d' END)
         ELSE '' END AS checks,
       CASE WHEN c_custkey % 11 = 0 THEN 'feat(core): custom ' || CAST(c_custkey AS STRING)
            WHEN c_custkey % 11 = 1 THEN 'no type here'
            WHEN c_custkey % 77 = 2 THEN '' END AS commit_message
FROM customer""",
    # Migration requests: one per repository and target.
    "plan_requests": """
SELECT DISTINCT repo_id || '-' || target AS plan_id, repo_id, target AS target_architecture,
       CASE CAST(floor(l_suppkey / 20) AS BIGINT) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END
         AS safety_level
FROM (SELECT 'repo' || CAST(CAST(floor(l_suppkey / 20) AS BIGINT) AS STRING) AS repo_id, l_suppkey,
             CASE l_linenumber WHEN 1 THEN 'domain-driven' WHEN 2 THEN 'event-driven' WHEN 3 THEN 'microservices'
               ELSE 'generic' END AS target
      FROM lineitem) AS t""",
}
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
TEXT_TABLES = ["documents", "pages", "benchmark", "conversations"]


def _uses(sql: str, names) -> list[str]:
    return [name for name in names if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding view (or driver table) as a DataFrame, without touching the catalog."""
    if name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        # A small driver table is one row group, hence one task. The views expand
        # rows to text, so spread its narrow rows over idle cores first. Text stays in its scan.
        if name in TEXT_TABLES:
            return table
        cores = spark.sparkContext.defaultParallelism
        return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
    sql = VIEWS[name]
    inputs = _uses(sql, TABLES) + _uses(sql, VIEWS)
    frames = {used: view(spark, sf_dir, used) for used in inputs}
    # {name} placeholders let one SQL text serve both engines.
    text = sql.replace("{", "{{").replace("}", "}}")
    for used in inputs:
        text = re.sub(rf"\b(FROM|JOIN)\s+{used}\b", rf"\1 {{{used}}}", text)
    return spark.sql(text, **frames)


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` (a SELECT) preceded by the views and ``extra`` CTEs it reads, for DuckDB."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def add(sql: str, within: tuple[str, ...]) -> None:
        for name in _uses(sql, known):
            if name not in order and name not in within:  # a recursive CTE reads itself
                add(known[name], (*within, name))
                order.append(name)

    add(body, ())
    ctes = ", ".join(f"{name} AS ({known[name].strip()})" for name in order)
    return f"WITH RECURSIVE {ctes} {body.strip()}" if ctes else body.strip()
