"""The same results in DuckDB SQL, written independently of the Spark operators."""

from __future__ import annotations

from fleetscope import catalogue as c

from .bindings import CONTENT_LINES, with_views

PARTS: dict[str, str] = {}
BODIES: dict[str, str] = {}


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SPACE = r"[\t\n\v\f\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A pattern literal with Python's meaning of blanks and word characters."""
    spelled = pattern.replace(r"\s", _SPACE).replace(r"\w", r"[\p{L}\p{N}_]")
    return q(("(?i)" if ignore_case else "") + spelled)


def has_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def matches(text: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({text}, {rx(pattern, ignore_case)})"


# --- diffs -------------------------------------------------------------------------


def _risk_parts(source: str, tag: str) -> None:
    PARTS[f"{tag}_raw"] = f"""
SELECT change_set_id, ordinal, unnest(string_split(diff, chr(10))) AS raw,
       generate_subscripts(string_split(diff, chr(10)), 1) AS pos
FROM {source}"""
    PARTS[f"{tag}_lines"] = f"""
SELECT change_set_id, ordinal, left(raw, 1) AS side, substr(raw, 2) AS line, pos,
       CAST(row_number() OVER (PARTITION BY change_set_id, ordinal, left(raw, 1) ORDER BY pos) - 1 AS INTEGER) AS position
FROM {tag}_raw
WHERE (starts_with(raw, '-') AND NOT starts_with(raw, '---'))
   OR (starts_with(raw, '+') AND NOT starts_with(raw, '+++'))"""
    define = r"def\s+(\w+)\s*\(([^)]*)\)"
    PARTS[f"{tag}_signatures"] = f"""
SELECT change_set_id, ordinal, side, function, arg_max(params, pos) AS params FROM (
  SELECT change_set_id, ordinal, side, pos, regexp_extract(line, {rx(define)}, 1) AS function,
         list_filter(list_transform(string_split(regexp_extract(line, {rx(define)}, 2), ','), lambda p: trim(p)),
                     lambda p: p <> '') AS params
  FROM {tag}_lines WHERE {matches('line', define)}) AS d
GROUP BY ALL"""
    PARTS[f"{tag}_parameters"] = f"""
SELECT r.change_set_id, r.ordinal, s.file_path, r.function,
       list_sort(list_distinct(list_filter(r.params, lambda p: NOT list_contains(a.params, p)))) AS removed_params,
       list_sort(list_distinct(list_filter(a.params, lambda p: NOT list_contains(r.params, p)))) AS added_params
FROM {tag}_signatures AS r
JOIN {tag}_signatures AS a ON r.change_set_id = a.change_set_id AND r.ordinal = a.ordinal AND r.function = a.function
JOIN {source} AS s ON s.change_set_id = r.change_set_id AND s.ordinal = r.ordinal
WHERE r.side = '-' AND a.side = '+' AND r.params <> a.params AND s.change_type IN ('modify', 'delete')"""
    columns = []
    for i, pattern in enumerate(c.DIFF_ROUTE_PATTERNS):
        columns.append(f"arg_min(line, pos) FILTER (side = '-' AND {matches('line', pattern)}) AS gone{i}")
        columns.append(f"count(*) FILTER (side = '+' AND {matches('line', pattern)}) AS came{i}")

    def count(name: str, side: str, condition: str) -> None:
        columns.append(f"count(*) FILTER (side = '{side}' AND {condition}) AS {name}")

    for name, words in [("cond", c.CONDITION_WORDS), ("exc", c.EXCEPTION_WORDS), ("loop", c.LOOP_WORDS),
                        ("query", c.QUERY_WORDS), ("auth", c.AUTH_WORDS)]:
        count(f"{name}_gone", "-", has_any("line", words))
        count(f"{name}_came", "+", has_any("line", words))
    for name, side in [("gone", "-"), ("came", "+")]:
        columns.append(f"coalesce(list(line ORDER BY pos) FILTER (side = '{side}' AND contains(line, 'return ')), []) AS ret_{name}")
    count("asyncs", "+", "contains(line, 'async ')")
    count("blocking", "+", has_any("line", c.BLOCKING_WORDS))
    count("injected", "+", "(" + " OR ".join(matches("line", p, True) for p in c.SQL_BUILDING_PATTERNS) + ")")
    count("fstring", "+", matches("line", c.SQL_FSTRING_PATTERN, True))
    count("secret", "+", "(" + " OR ".join(matches("line", p, True) for p in c.SECRET_PATTERNS) + ")")
    PARTS[f"{tag}_edits"] = f"""
SELECT s.change_set_id, s.ordinal, s.file_path, {", ".join(columns)}
FROM {source} AS s JOIN {tag}_lines AS l ON s.change_set_id = l.change_set_id AND s.ordinal = l.ordinal
WHERE s.change_type IN ('modify', 'delete') GROUP BY s.change_set_id, s.ordinal, s.file_path"""

    def rule(rule_id: str, where: str, sub: str = "0", description: str | None = None, subject: str = "NULL",
             severity: str | None = None, table: str = f"{tag}_edits") -> str:
        r = c.RISK_BY_ID[rule_id]
        return f"""
SELECT change_set_id, ordinal, {r.stage} AS stage, CAST({sub} AS INTEGER) AS sub_ordinal, {q(rule_id)} AS rule_id,
       {q(r.type)} AS type, {severity or q(r.severity)} AS severity, {description or q(r.description)} AS description,
       CAST({subject} AS VARCHAR) AS subject, file_path AS component
FROM {table} WHERE {where}"""

    clean = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
    rules = []
    for i in range(len(c.DIFF_ROUTE_PATTERNS)):
        line = clean.format(f"gone{i}")
        rules.append(rule("R01", f"gone{i} IS NOT NULL AND came{i} = 0", str(i), f"'API endpoint removed: ' || {line}", line))
        rules.append(rule("R02", f"gone{i} IS NOT NULL AND came{i} > 0", str(i), "'API endpoint modified in ' || file_path"))
    rules += [
        rule("R03", "true", "row_number() OVER (PARTITION BY change_set_id, ordinal ORDER BY function) - 1",
             "'Function parameters changed: ' || function", "function",
             "CASE WHEN len(removed_params) > 0 THEN 'high' ELSE 'medium' END", f"{tag}_parameters"),
        rule("R04", "cond_gone > 0 AND cond_came > 0"),
        rule("R05", "ret_gone <> ret_came"),
        rule("R06", "exc_gone + exc_came > 0"),
        rule("R07", "loop_came > loop_gone"),
        rule("R08", "query_came > query_gone"),
        rule("R09", "asyncs > 0 AND blocking > 0"),
        rule("R10", "injected > 0"),
        rule("R10b", "fstring > 0", "1"),
        rule("R11", "auth_gone > 0 AND auth_came = 0"),
        rule("R12", "secret > 0"),
        rule("R13", f"change_type = 'add' AND {has_any('diff', c.DEPENDENCY_WORDS)}", table=source),
        rule("R14", "change_type = 'rename'", description="'File renamed: ' || file_path", table=source),
    ]
    PARTS[f"{tag}_risks"] = " UNION ALL ".join(rules)


_risk_parts("code_changes", "o")
_risk_parts("text_changes", "t")

BODIES["diff_lines"] = "SELECT change_set_id, ordinal, side, position, line FROM o_lines"
BODIES["function_signatures"] = """
SELECT change_set_id, ordinal, side, function, array_to_string(params, ',') AS params FROM o_signatures"""
BODIES["parameter_changes"] = """
SELECT change_set_id, ordinal, file_path, function, array_to_string(removed_params, ',') AS removed_params,
       array_to_string(added_params, ',') AS added_params FROM o_parameters"""
BODIES["change_risks"] = "SELECT * FROM o_risks"
BODIES["text_risks"] = "SELECT * FROM t_risks"
_interface = f"change_type = 'modify' AND {has_any('diff', c.INTERFACE_WORDS)}"
PARTS["o_set_risks"] = f"""
SELECT change_set_id, 'R15' AS rule_id, {q(c.RISK_BY_ID['R15'].type)} AS type, 'high' AS severity,
       {q(c.RISK_BY_ID['R15'].description)} AS description, count(DISTINCT file_path) AS n_components
FROM code_changes WHERE {_interface} GROUP BY change_set_id HAVING count(DISTINCT file_path) > 1
UNION ALL
SELECT change_set_id, 'R16', {q(c.RISK_BY_ID['R16'].type)}, 'medium', {q(c.RISK_BY_ID['R16'].description)}, count(*)
FROM code_changes GROUP BY change_set_id HAVING count(*) > 10"""
BODIES["change_set_risks"] = "SELECT * FROM o_set_risks"
BODIES["interface_components"] = f"SELECT DISTINCT change_set_id, file_path FROM code_changes WHERE {_interface}"
BODIES["first_changed_files"] = """
SELECT change_set_id, array_to_string(list_slice(list(file_path ORDER BY ordinal), 1, 5), ',') || ',...'
       AS affected_components
FROM code_changes GROUP BY change_set_id HAVING count(*) > 10"""
PARTS["o_found"] = """
SELECT change_set_id, type, description, component, rule_id, severity, subject, n_components, ordinal, stage, sub_ordinal
FROM (
  SELECT *, row_number() OVER (PARTITION BY change_set_id, type, description, component
                               ORDER BY ordinal, stage, sub_ordinal) AS nth
  FROM (
    SELECT change_set_id, ordinal, stage, sub_ordinal, rule_id, type, severity, description, subject, component,
           1 AS n_components FROM o_risks
    UNION ALL
    SELECT change_set_id, NULL, CASE rule_id WHEN 'R15' THEN 15 ELSE 16 END, 0, rule_id, type, severity,
           description, NULL, NULL, n_components FROM o_set_risks) AS a) AS n
WHERE nth = 1"""
BODIES["distinct_risks"] = """
SELECT change_set_id, type, description, component, rule_id, severity, subject, n_components FROM o_found"""
_priority = (
    "CAST(10 * CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
    " + CASE type WHEN 'security' THEN 4 WHEN 'api_change' THEN 3 WHEN 'behavior_change' THEN 2"
    " WHEN 'performance' THEN 1 ELSE 0 END AS INTEGER)"
)

# --- facts: structure follows from how the binding writes its files ---------------------

PARTS["ok_keys"] = "SELECT * FROM file_keys WHERE k % 101 <> 0"
PARTS["ok_files"] = "SELECT * FROM code_files WHERE NOT contains(content, 'def broken(')"
BODIES["file_complexity"] = """
SELECT repo_id, path, true AS parses, CAST(2 + CASE WHEN n % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END
       AS INTEGER) AS complexity FROM ok_keys
UNION ALL SELECT repo_id, path, false, NULL FROM code_files WHERE contains(content, 'def broken(')"""
BODIES["ledger_state"] = """
SELECT plan_id, step_id, commit_id, message, n_entries FROM (
  SELECT *, count(*) OVER (PARTITION BY plan_id, step_id) AS n_entries,
         row_number() OVER (PARTITION BY plan_id, step_id ORDER BY made_at DESC, commit_id DESC) AS place FROM ledger) t
WHERE place = 1"""
BODIES["facts_of_second_run"] = f"SELECT *, 0 AS parsed_again FROM ({BODIES['file_complexity']})"
_imports = [
    ("k % 2 = 0", "requests", None, "import"), ("k % 5 = 0", "os.path", "p", "import"), ("k % 5 = 0", "sys", None, "import"),
    ("k % 7 = 0", "flask.Flask", None, "from_import"), ("k % 7 = 0", "flask.jsonify", "j", "from_import"),
    ("k % 11 = 0", ".util", None, "from_import"),
]
BODIES["imports"] = " UNION ALL ".join(
    f"SELECT repo_id, service, path, {q(m)} AS module, {q(a) if a else 'NULL'} AS alias, {q(t)} AS type FROM ok_keys WHERE {w}"
    for w, m, a, t in _imports
)


def line_of(start: str) -> str:
    """Line number of the generated line whose text begins with ``start``."""
    before = []
    for text, condition in CONTENT_LINES:
        if text.startswith("'" + start):
            return "CAST(1 + " + " + ".join(f"CASE WHEN {w} THEN 1 ELSE 0 END" for w in before) + " AS INTEGER)"
        before.append(condition or "true")
    raise KeyError(start)


BODIES["classes"] = f"""
SELECT repo_id, service, path, 'C' || CAST(p % 5 AS STRING) AS name, 'm1' AS methods, 'Base,m.Mixin,unknown' AS bases,
       CASE WHEN k % 16 = 0 THEN 'reg.add' ELSE '' END AS decorators, {line_of("class C")} AS line_number
FROM ok_keys WHERE k % 8 = 0"""
_marks = ["k % (40 + 8 * svc) = 0", "k % 180 = 1", "k % 240 = 2", "k % 200 = 4"]
BODIES["functions"] = f"""
SELECT repo_id, service, path, 'h' AS name, 'a,b' AS args,
       concat_ws(',', {", ".join(f"CASE WHEN {m} THEN 'unknown' END" for m in _marks)}) AS decorators, 'm.T' AS returns,
       {line_of("def h(")} AS line_number, CAST(2 + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS INTEGER) AS complexity
FROM ok_keys
UNION ALL SELECT repo_id, service, path, 'inner', 'c', '', NULL, {line_of("    def inner")}, 2 FROM ok_keys WHERE k % 9 = 0
UNION ALL SELECT repo_id, service, path, 'm1', 'self', 'prop', NULL, {line_of("    def m1")}, 1 FROM ok_keys WHERE k % 8 = 0"""
PARTS["o_libraries"] = " UNION ALL ".join(
    f"SELECT repo_id, service, path, {q(name)} AS library FROM ok_files WHERE {matches('content', p)}"
    for name, p in c.LIBRARY_CALL_PATTERNS.items()
)
BODIES["external_dependencies"] = "SELECT * FROM o_libraries"
_verbs = [
    f"""SELECT repo_id, service, path AS file_path, {i} AS family, {q(f)} AS framework,
  unnest(regexp_extract_all(content, {rx(p)}, 1)) AS verb, unnest(regexp_extract_all(content, {rx(p)}, 2)) AS path,
  generate_subscripts(regexp_extract_all(content, {rx(p)}, 1), 1) AS pos FROM ok_files"""
    for i, (f, p) in enumerate(c.ENDPOINT_PATTERNS.items())
]
PARTS["o_endpoints"] = f"""
SELECT repo_id, service, file_path, path, framework,
       CASE WHEN verb IN ('route', 'resource') THEN 'GET' ELSE upper(verb) END AS method,
       CAST(row_number() OVER (PARTITION BY repo_id, service, file_path ORDER BY family, pos) - 1 AS INTEGER) AS ordinal
FROM ({" UNION ALL ".join(_verbs)}) AS v"""
BODIES["endpoints"] = "SELECT * FROM o_endpoints"


def _db(source: str, keys: str) -> str:
    found = []
    for family, p in c.DB_QUERY_PATTERNS.items():
        table = f"unnest(regexp_extract_all(content, {rx(p, True)}, 2))" if family == "sql" else "'unknown'"
        found.append(f"""SELECT {keys}, {q(family)} AS type,
  unnest(regexp_extract_all(content, {rx(p, True)}, 1)) AS operation, {table} AS "table" FROM {source}""")
    return " UNION ALL ".join(found)


PARTS["o_db_queries"] = _db("ok_files", "repo_id, service, path")
BODIES["db_queries"] = "SELECT * FROM o_db_queries"
BODIES["text_db_queries"] = _db("text_files", "repo_id, path")
BODIES["requested_files"] = """
SELECT r.repo_id, r.path,
       CASE WHEN f.path IS NULL THEN 'File not found: ' || r.path
            WHEN contains(f.content, 'def broken(') THEN 'Syntax error in ' || r.path END AS reason,
       CASE WHEN NOT contains(f.content, 'def broken(') THEN CAST(2 + CASE WHEN contains(f.content, ' and b or x') THEN 2 ELSE 0 END
            + CASE WHEN contains(f.content, 'for i in c') THEN 1 ELSE 0 END AS INTEGER) END AS complexity
FROM file_requests AS r LEFT JOIN code_files AS f ON r.repo_id = f.repo_id AND r.path = f.path"""
_layouts = [
    f"SELECT repo_id, {i} AS rank, regexp_extract(path, {q('^(' + layout.replace('*', '[^/]*') + ')/')}, 1) AS svc_path FROM code_paths"
    f" WHERE path LIKE '%.py' OR path LIKE '%.js'"
    for i, layout in enumerate(c.SERVICE_LAYOUTS)
]
BODIES["discovered_services"] = f"""
SELECT repo_id, service, svc_path FROM (
  SELECT repo_id, service, svc_path,
         row_number() OVER (PARTITION BY repo_id, service ORDER BY rank DESC, svc_path DESC) AS nth
  FROM (SELECT repo_id, rank, svc_path, replace(replace(last_name, '-service', ''), '-api', '') AS service FROM (
          SELECT *, list_extract(string_split(svc_path, '/'), -1) AS last_name
          FROM ({" UNION ALL ".join(_layouts)}) AS a WHERE svc_path <> '') AS b
        WHERE NOT starts_with(last_name, '.')) AS d) AS e
WHERE nth = 1"""
BODIES["mapped_services"] = """
SELECT f.repo_id, f.path, m.service FROM code_files AS f
JOIN service_map AS m ON f.repo_id = m.repo_id AND starts_with(f.path, m.svc_path || '/')"""

# --- rollups and dependencies -------------------------------------------------------------

PARTS["o_tables"] = "SELECT DISTINCT repo_id, service, \"table\" FROM o_db_queries WHERE \"table\" <> 'unknown'"
PARTS["o_sizes"] = """
SELECT repo_id, service, count(*) AS n_files,
       CAST(sum(2 + CASE WHEN n % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS complexity
FROM ok_keys GROUP BY repo_id, service"""
PARTS["o_rollup"] = """
SELECT s.repo_id, s.service, coalesce(z.n_files, 0) AS n_files, coalesce(z.complexity, 0) AS complexity,
       coalesce(e.n, 0) AS n_endpoints, coalesce(t.n, 0) AS n_tables, coalesce(l.n, 0) AS n_external_dependencies
FROM (SELECT DISTINCT repo_id, service FROM code_files) AS s
LEFT JOIN o_sizes AS z ON s.repo_id = z.repo_id AND s.service = z.service
LEFT JOIN (SELECT repo_id, service, count(*) AS n FROM o_endpoints GROUP BY ALL) AS e
  ON s.repo_id = e.repo_id AND s.service = e.service
LEFT JOIN (SELECT repo_id, service, count(*) AS n FROM o_tables GROUP BY ALL) AS t
  ON s.repo_id = t.repo_id AND s.service = t.service
LEFT JOIN (SELECT repo_id, service, count(DISTINCT library) AS n FROM o_libraries GROUP BY ALL) AS l
  ON s.repo_id = l.repo_id AND s.service = l.service"""
BODIES["service_rollup"] = "SELECT * FROM o_rollup"
BODIES["mean_complexity"] = "SELECT repo_id, service, complexity / greatest(n_files, 1) AS mean_complexity FROM o_rollup"
BODIES["service_tables"] = "SELECT * FROM o_tables"
BODIES["service_libraries"] = "SELECT DISTINCT repo_id, service, library FROM o_libraries"
# The calls as the binding writes them; a declared route is none.
PARTS["o_mentions"] = """
SELECT DISTINCT repo_id, service, '//h/v1/p/' || (p % 20) || '/' || (k % 50) || '/x' AS mention FROM ok_keys WHERE k % 30 = 0
UNION SELECT DISTINCT repo_id, service, '//h/v1/health' FROM ok_keys WHERE k % 30 = 10 AND svc = 3"""
PARTS["o_dependencies"] = """
SELECT e.repo_id, m.service AS source, e.service AS target, e.path, 'api' AS dependency_type,
       CAST(0.7 AS DOUBLE) AS strength, e.declarations
FROM (SELECT repo_id, service, path, count(*) AS declarations FROM o_endpoints GROUP BY ALL) AS e
JOIN (SELECT repo_id, service, string_agg(mention || '/', chr(10)) AS code FROM o_mentions GROUP BY ALL) AS m
  ON e.repo_id = m.repo_id AND e.service <> m.service AND contains(m.code, e.path || '/')"""
BODIES["endpoint_dependencies"] = "SELECT * FROM o_dependencies"
PARTS["o_edges"] = "SELECT repo_id, source, target, max(strength) AS weight FROM o_dependencies GROUP BY ALL"
BODIES["dependency_edges"] = "SELECT * FROM o_edges"


def _centrality(edges: str) -> str:
    return f"""
SELECT repo_id, service, count(*) AS degree,
       count(*) / (count(*) OVER (PARTITION BY repo_id) - 1) AS centrality
FROM (SELECT repo_id, source AS service FROM {edges} UNION ALL SELECT repo_id, target FROM {edges}) AS n
GROUP BY repo_id, service"""


PARTS["o_centrality"] = _centrality("o_edges")
BODIES["degree_centrality"] = _centrality("service_edges")
PARTS["o_metrics"] = """
SELECT r.repo_id, total_services, coalesce(total_dependencies, 0) AS total_dependencies,
       complexity / greatest(total_services, 1) AS avg_service_complexity,
       coalesce(total_dependencies, 0) / greatest(total_services * (total_services - 1), 1) AS coupling_score,
       n_endpoints / greatest(total_services, 1) AS avg_endpoints_per_service, max_centrality, avg_centrality
FROM (SELECT repo_id, count(*) AS total_services, CAST(sum(complexity) AS BIGINT) AS complexity,
             CAST(sum(n_endpoints) AS BIGINT) AS n_endpoints FROM o_rollup GROUP BY repo_id) AS r
LEFT JOIN (SELECT repo_id, CAST(sum(declarations) AS BIGINT) AS total_dependencies FROM o_dependencies GROUP BY repo_id) AS d
  ON r.repo_id = d.repo_id
LEFT JOIN (SELECT repo_id, max(centrality) AS max_centrality, avg(centrality) AS avg_centrality FROM o_centrality
           GROUP BY repo_id) AS m ON r.repo_id = m.repo_id"""
BODIES["fleet_metrics"] = "SELECT * REPLACE (round(avg_centrality, 9) AS avg_centrality) FROM o_metrics"
PARTS["o_dependents"] = """
SELECT r.repo_id, r.service, CAST(coalesce(sum(d.declarations), 0) AS BIGINT) AS n_dependents
FROM o_rollup AS r LEFT JOIN o_dependencies AS d ON r.repo_id = d.repo_id AND r.service = d.target
GROUP BY r.repo_id, r.service"""
BODIES["dependents"] = "SELECT * FROM o_dependents"
PARTS["o_shared"] = """
SELECT t.repo_id, t."table", t.service, n_services
FROM o_tables AS t JOIN (SELECT repo_id, "table", count(*) AS n_services FROM o_tables GROUP BY ALL) AS n
  ON t.repo_id = n.repo_id AND t."table" = n."table" WHERE n_services > 1"""
BODIES["shared_tables"] = "SELECT * FROM o_shared"
# The greedy grouping, one service after the other.
PARTS["o_sharers"] = """
SELECT repo_id, service, row_number() OVER (PARTITION BY repo_id ORDER BY service) AS idx, near
FROM (SELECT a.repo_id, a.service, list(DISTINCT b.service) AS near
      FROM o_tables AS a JOIN o_tables AS b ON a.repo_id = b.repo_id AND a."table" = b."table" GROUP BY ALL) AS n"""
PARTS["o_greedy"] = """
SELECT DISTINCT repo_id, CAST(0 AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS seed, CAST([] AS VARCHAR[]) AS members,
       CAST([] AS VARCHAR[]) AS done
FROM o_sharers
UNION ALL
SELECT g.repo_id, s.idx, s.service,
       CASE WHEN list_contains(g.done, s.service) THEN [] ELSE list_filter(s.near, lambda x: NOT list_contains(g.done, x)) END,
       CASE WHEN list_contains(g.done, s.service) OR len(list_filter(s.near, lambda x: NOT list_contains(g.done, x))) < 2
            THEN g.done ELSE list_concat(g.done, s.near) END
FROM o_greedy AS g JOIN o_sharers AS s ON g.repo_id = s.repo_id AND s.idx = g.idx + 1"""
PARTS["o_groups"] = """
SELECT repo_id, seed, unnest(members) AS service, len(members) AS n_services FROM o_greedy WHERE len(members) > 1"""
BODIES["sharing_groups"] = "SELECT * FROM o_groups"
PARTS["o_smells"] = f"""
SELECT repo_id, 'god_service' AS type, 'high' AS severity, service AS location,
       'Service has ' || n_endpoints || ' endpoints, consider splitting' AS description,
       {q(c.GOD_SERVICE_FIX)} AS suggested_fix FROM o_rollup WHERE n_endpoints > 20
UNION ALL
SELECT repo_id, 'high_complexity', 'medium', service,
       'Average file complexity is ' || printf('%.1f', complexity / greatest(n_files, 1)), {q(c.HIGH_COMPLEXITY_FIX)}
FROM o_rollup WHERE complexity / greatest(n_files, 1) > 10"""
BODIES["service_smells"] = "SELECT * FROM o_smells"
PARTS["o_shared_smells"] = f"""
SELECT repo_id, 'shared_database' AS type, 'high' AS severity, service AS location,
       'Services share database tables: ' || "table" || ' (used by ' || n_services || ' services)' AS description,
       {q(c.SHARED_DATABASE_FIX)} AS suggested_fix FROM o_shared"""
BODIES["shared_database_smells"] = "SELECT * FROM o_shared_smells"
BODIES["smells_by_type"] = """
SELECT repo_id, type, count(*) AS n_smells FROM (SELECT * FROM o_smells UNION ALL SELECT * FROM o_shared_smells) AS s
GROUP BY repo_id, type"""
PARTS["o_walks"] = """
SELECT repo_id, source AS start, target AS tail, [source, target] AS nodes, false AS closed FROM service_edges
WHERE source < target
UNION ALL
SELECT w.repo_id, w.start, e.target, CASE WHEN e.target = w.start THEN w.nodes ELSE list_append(w.nodes, e.target) END,
       e.target = w.start
FROM o_walks AS w JOIN service_edges AS e ON w.repo_id = e.repo_id AND w.tail = e.source
WHERE NOT w.closed AND (e.target = w.start OR (e.target > w.start AND NOT list_contains(w.nodes, e.target)))"""
BODIES["circular_dependencies"] = "SELECT repo_id, array_to_string(nodes, ',') AS cycle FROM o_walks WHERE closed"
PARTS["o_round"] = """
SELECT repo_id, source AS a, target AS b FROM o_edges
UNION SELECT r.repo_id, r.a, e.target FROM o_round AS r JOIN o_edges AS e ON e.repo_id = r.repo_id AND e.source = r.b"""
BODIES["circular_groups"] = """
SELECT x.repo_id, min(x.b) AS component, x.a AS service
FROM o_round AS x JOIN o_round AS y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a GROUP BY x.repo_id, x.a"""
BODIES["over_complex_services"] = """
SELECT repo_id, service, complexity, 'Consider breaking down ' || service || ' - complexity score: ' || complexity
       AS recommendation FROM o_rollup WHERE complexity > 100"""
BODIES["unversioned_endpoints"] = "SELECT * FROM o_endpoints WHERE NOT contains(path, '/v')"
BODIES["first_unversioned"] = """
SELECT repo_id, position, service || ':' || path AS endpoint FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY service, file_path, ordinal) AS INTEGER) AS position
  FROM o_endpoints WHERE NOT contains(path, '/v')) AS u WHERE position <= 5"""
BODIES["database_advice"] = f"""
SELECT repo_id, count(*) AS services_with_tables, {q(c.DATABASE_ADVICE)} AS recommendation
FROM o_rollup WHERE n_tables > 0 GROUP BY repo_id HAVING count(*) > 1"""
BODIES["high_coupling"] = """
SELECT c.repo_id, 'high_coupling' AS type, service, centrality AS risk_score,
       service || ' is highly coupled with ' || CAST(floor(centrality * n) AS BIGINT) || ' other services' AS description
FROM o_centrality AS c JOIN (SELECT repo_id, count(*) AS n FROM o_rollup GROUP BY repo_id) AS s
  ON c.repo_id = s.repo_id WHERE centrality > 0.5"""
BODIES["single_points_of_failure"] = """
SELECT d.repo_id, 'single_point_of_failure' AS type, service, n_dependents / n AS risk_score,
       service || ' is a dependency for ' || n_dependents || ' services' AS description
FROM o_dependents AS d JOIN (SELECT repo_id, count(*) AS n FROM o_rollup GROUP BY repo_id) AS s
  ON d.repo_id = s.repo_id WHERE n_dependents > n * 0.5"""

# --- backlog ------------------------------------------------------------------------------

PARTS["o_wanted"] = """
SELECT plan_id, unnest(string_split(wanted, ',')) AS p, generate_subscripts(string_split(wanted, ','), 1) AS i
FROM plan_priorities WHERE wanted <> ''"""
PARTS["o_ranked"] = """
SELECT s.*, CAST(CASE WHEN n.n IS NULL THEN 0 ELSE coalesce(l.last - 1, n.n) END AS INTEGER) AS priority_rank
FROM plan_steps AS s
LEFT JOIN (SELECT plan_id, count(*) AS n FROM o_wanted GROUP BY plan_id) AS n ON s.plan_id = n.plan_id
LEFT JOIN (SELECT s.plan_id, s.ordinal, arg_min(w.p, w.i) AS p FROM plan_steps AS s JOIN o_wanted AS w
           ON s.plan_id = w.plan_id AND (contains(s.type, w.p) OR contains(lower(s.description), w.p))
           GROUP BY s.plan_id, s.ordinal) AS f ON s.plan_id = f.plan_id AND s.ordinal = f.ordinal
LEFT JOIN (SELECT plan_id, p, max(i) AS last FROM o_wanted GROUP BY plan_id, p) AS l
  ON f.plan_id = l.plan_id AND f.p = l.p"""
BODIES["prioritized_steps"] = "SELECT plan_id, ordinal, id, priority_rank FROM o_ranked"
PARTS["o_needs"] = """
SELECT DISTINCT plan_id, id AS target, unnest(string_split(depends_on, ',')) AS needs FROM plan_steps
WHERE depends_on <> ''"""
PARTS["o_exact"] = """
SELECT DISTINCT n.plan_id, n.needs AS source, n.target FROM o_needs AS n
JOIN plan_steps AS s ON n.plan_id = s.plan_id AND n.needs = s.id WHERE NOT n.needs LIKE '%*'"""
PARTS["o_wild"] = """
SELECT DISTINCT n.plan_id, n.needs, s.id AS source, n.target FROM o_needs AS n
JOIN plan_steps AS s ON n.plan_id = s.plan_id AND starts_with(s.id, rtrim(n.needs, '*')) WHERE n.needs LIKE '%*'"""
BODIES["exact_dependencies"] = "SELECT * FROM o_exact"
BODIES["resolved_dependencies"] = """
SELECT plan_id, source, target FROM o_exact
UNION SELECT plan_id, source, 'wildcard ' || needs FROM o_wild
UNION SELECT plan_id, 'wildcard ' || needs, target FROM o_wild"""
PARTS["o_direct"] = "SELECT plan_id, source, target FROM o_exact UNION SELECT plan_id, source, target FROM o_wild"
PARTS["o_nodes"] = "SELECT plan_id, count(DISTINCT id) AS n FROM plan_steps GROUP BY plan_id"
# A walk of as many steps as the plan has nodes goes round a cycle.
PARTS["o_reach"] = """
SELECT DISTINCT plan_id, id, 0 AS level FROM plan_steps
UNION
SELECT r.plan_id, d.target, r.level + 1 FROM o_reach AS r
JOIN o_direct AS d ON r.plan_id = d.plan_id AND r.id = d.source
JOIN o_nodes AS n ON r.plan_id = n.plan_id WHERE r.level < n.n"""
PARTS["o_levels"] = """
SELECT r.plan_id, r.id, CAST(max(r.level) AS INTEGER) AS level FROM o_reach AS r JOIN o_nodes AS n ON r.plan_id = n.plan_id
GROUP BY r.plan_id, r.id, n.n HAVING max(r.level) < n.n"""
BODIES["step_levels"] = "SELECT * FROM o_levels"
PARTS["o_cyclic"] = """
SELECT DISTINCT r.plan_id FROM o_reach AS r JOIN o_nodes AS n ON r.plan_id = n.plan_id WHERE r.level = n.n"""


def _ordered(source: str) -> str:
    return f"""
SELECT l.plan_id, l.id, l.ordinal, l.priority_rank, v.level, l.type, l.description, l.estimated_effort, l.risk_level
FROM (SELECT plan_id, id, min((priority_rank, ordinal))[1] AS priority_rank, min((priority_rank, ordinal))[2] AS ordinal,
             arg_max(type, ordinal) AS type, arg_max(description, ordinal) AS description,
             arg_max(estimated_effort, ordinal) AS estimated_effort, arg_max(risk_level, ordinal) AS risk_level
      FROM {source} GROUP BY plan_id, id) AS l
JOIN o_levels AS v ON l.plan_id = v.plan_id AND l.id = v.id
WHERE l.plan_id NOT IN (SELECT plan_id FROM o_cyclic)
UNION ALL
SELECT plan_id, id, ordinal, priority_rank, NULL, type, description, estimated_effort, risk_level FROM {source}
WHERE plan_id IN (SELECT plan_id FROM o_cyclic)"""


PARTS["o_unranked"] = "SELECT *, 0 AS priority_rank FROM plan_steps"
BODIES["ordered_steps"] = _ordered("o_ranked")
PARTS["o_ordered"] = _ordered("o_unranked")
BODIES["first_steps"] = """
SELECT plan_id, position, description, risk_level, greatest(n - 10, 0) AS n_more FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY level, priority_rank, ordinal) AS INTEGER) AS position,
         count(*) OVER (PARTITION BY plan_id) AS n FROM o_ordered) AS o WHERE position <= 10"""
PARTS["o_paths"] = """
SELECT DISTINCT e.plan_id, e.source AS tail, [e.source] AS nodes FROM o_exact AS e
WHERE NOT EXISTS (SELECT 1 FROM o_exact AS x WHERE x.plan_id = e.plan_id AND x.target = e.source)
UNION ALL
SELECT p.plan_id, e.target, list_append(p.nodes, e.target) FROM o_paths AS p
JOIN o_exact AS e ON p.plan_id = e.plan_id AND p.tail = e.source WHERE NOT list_contains(p.nodes, e.target)"""
BODIES["critical_paths"] = """
SELECT plan_id, position, array_to_string(nodes, ',') AS path FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY len(nodes) DESC, nodes) AS INTEGER) AS position
  FROM o_paths AS p WHERE NOT EXISTS (SELECT 1 FROM o_exact AS x WHERE x.plan_id = p.plan_id AND x.source = p.tail)) AS r
WHERE position <= 3"""
BODIES["risk_distribution"] = "SELECT plan_id, risk_level, count(*) AS n_steps FROM plan_steps GROUP BY ALL"
_totals = """count(*) AS n_steps, CAST(sum(estimated_effort) AS BIGINT) AS total_effort,
       count(*) FILTER (risk_level = 'high') AS high_risk_count,
       CAST(sum(CASE risk_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS BIGINT) AS total_risk_score"""
BODIES["plan_totals"] = f"SELECT plan_id, {_totals} FROM plan_steps GROUP BY plan_id"


def _step(key: str, stage: int, source: str, subject: str = "''", description: str | None = None,
          risk: str | None = None, fill: dict[str, str] | None = None) -> str:
    t = c.STEP_TEMPLATES[key]
    fill = fill or {"": subject}

    def filled(template: str) -> str:
        text = q(template)
        for name, column in fill.items():
            text = f"replace({text}, '{{{name}}}', {column})"
        return text

    return f"""
SELECT plan_id, repo_id, {filled(t.id)} AS id, {q(t.type)} AS type, {description or filled(t.description)} AS description,
       {q(','.join(t.target_files))} AS target_files, {q(','.join(t.dependencies))} AS dependencies,
       {t.effort} AS estimated_effort, {risk or q(t.risk_level)} AS risk_level,
       {q(','.join(t.validation_steps))} AS validation_steps, {filled(t.commit_message)} AS commit_message,
       {stage} AS stage, {subject} AS subject FROM {source}"""


def _joined_plans(target: str, other: str) -> str:
    return (
        f"(SELECT r.plan_id, r.repo_id, r.safety_level, o.* EXCLUDE (repo_id) FROM plan_requests AS r "
        f"JOIN ({other}) AS o ON r.repo_id = o.repo_id WHERE r.target_architecture = '{target}') AS j"
    )


def _plans(target: str, more: str = "true") -> str:
    return f"plan_requests WHERE target_architecture = '{target}' AND {more}"


PARTS["o_domain"] = " UNION ALL ".join([
    _step("extract_context", 1, _joined_plans("domain-driven", "SELECT repo_id, service FROM o_rollup WHERE n_endpoints > 10"),
          "service"),
    _step("aggregates", 2, _plans("domain-driven")), _step("domain_events", 3, _plans("domain-driven")),
    _step("repositories", 4, _plans("domain-driven")),
])
PARTS["o_event"] = " UNION ALL ".join([
    _step("broker", 1, _plans("event-driven")),
    _step("async_call", 2, _joined_plans("event-driven", "SELECT DISTINCT repo_id, source, target FROM o_dependencies"),
          "source || '-' || target", risk="CASE safety_level WHEN 'high' THEN 'high' ELSE 'medium' END",
          fill={"source": "source", "target": "target"}),
    _step("event_sourcing", 3, _plans("event-driven", "safety_level <> 'low'")),
])
PARTS["o_micro"] = " UNION ALL ".join([
    _step("separate_db", 1, _joined_plans("microservices", "SELECT DISTINCT repo_id, seed FROM o_groups"), "seed"),
    _step("api_versioning", 2, _joined_plans(
        "microservices", "SELECT DISTINCT repo_id, service FROM o_endpoints WHERE NOT contains(path, '/v')"), "service"),
    _step("service_mesh", 3, _plans("microservices", "safety_level = 'high'")),
])
PARTS["o_generic"] = " UNION ALL ".join([
    _step("split_god", 1, _joined_plans("generic", "SELECT * FROM o_smells WHERE type = 'god_service'"), "location",
          description="suggested_fix"),
    _step("reduce_complexity", 2, _joined_plans("generic", "SELECT * FROM o_smells WHERE type = 'high_complexity'"), "location",
          description="suggested_fix"),
])
for _name, _part in [("domain_driven_steps", "o_domain"), ("event_driven_steps", "o_event"),
                     ("microservice_steps", "o_micro"), ("generic_steps", "o_generic")]:
    BODIES[_name] = f"SELECT * FROM {_part}"
PARTS["o_backlog"] = """
SELECT * FROM o_domain UNION ALL SELECT * FROM o_event UNION ALL SELECT * FROM o_micro UNION ALL SELECT * FROM o_generic"""
BODIES["backlog_by_plan"] = """
SELECT plan_id, type, risk_level, count(*) AS n_steps, CAST(sum(estimated_effort) AS BIGINT) AS effort FROM o_backlog
GROUP BY ALL"""
BODIES["step_files"] = """
SELECT b.plan_id, b.id AS step_id, f.path FROM o_backlog AS b
JOIN ok_files AS f ON b.repo_id = f.repo_id AND b.subject = f.service
WHERE b.id LIKE 'extract-context-%' OR (b.id LIKE 'api-versioning-%' AND (contains(f.path, 'api') OR contains(f.path, 'route')))"""
PARTS["o_criteria"] = f"""
SELECT plan_id, CAST(i - 1 AS INTEGER) AS ordinal, criterion FROM (
  SELECT plan_id, unnest(l) AS criterion, generate_subscripts(l, 1) AS i FROM (
    SELECT plan_id, list_concat(list_concat([{", ".join(map(q, c.BASE_CRITERIA))}],
      CASE target_architecture {" ".join(f"WHEN {q(t)} THEN [{', '.join(map(q, v))}]" for t, v in c.TARGET_CRITERIA.items())}
        ELSE [] END),
      CASE WHEN coupling_score > 0.3
           THEN ['Coupling score reduced below 0.3 (current: ' || printf('%.2f', coupling_score) || ')'] ELSE [] END) AS l
    FROM plan_requests AS r LEFT JOIN o_metrics AS m ON r.repo_id = m.repo_id) AS a) AS b"""
BODIES["success_criteria"] = "SELECT * FROM o_criteria"
PARTS["o_plan_totals"] = f"SELECT plan_id, {_totals} FROM o_backlog GROUP BY plan_id"
# Exact dependencies of the templates chain at most two steps.
PARTS["o_chain"] = """
SELECT b.plan_id, max(2) AS n FROM o_backlog AS b JOIN o_backlog AS p ON b.plan_id = p.plan_id AND b.dependencies = p.id
GROUP BY b.plan_id"""
PARTS["o_plans"] = """
SELECT r.plan_id, r.repo_id, r.target_architecture, r.safety_level, coalesce(n_steps, 0) AS n_steps,
       coalesce(total_effort, 0) AS total_effort, coalesce(high_risk_count, 0) AS high_risk_count,
       coalesce(total_risk_score, 0) AS total_risk_score, coalesce(k.n, 0) AS n_criteria,
       CAST(coalesce(x.n, 0) AS INTEGER) AS critical_path_steps
FROM plan_requests AS r LEFT JOIN o_plan_totals AS t ON r.plan_id = t.plan_id
LEFT JOIN (SELECT plan_id, count(*) AS n FROM o_criteria GROUP BY plan_id) AS k ON r.plan_id = k.plan_id
LEFT JOIN o_chain AS x ON r.plan_id = x.plan_id"""
BODIES["assembled_plans"] = "SELECT * FROM o_plans"
BODIES["run_summary"] = """
SELECT p.plan_id, p.repo_id, p.target_architecture, p.safety_level, total_services, total_dependencies,
       coalesce(s.n, 0) AS n_smells, avg_service_complexity, n_steps, total_effort
FROM o_plans AS p LEFT JOIN o_metrics AS m ON p.repo_id = m.repo_id
LEFT JOIN (SELECT repo_id, count(*) AS n FROM (SELECT * FROM o_smells UNION ALL SELECT * FROM o_shared_smells) AS a
           GROUP BY repo_id) AS s ON p.repo_id = s.repo_id"""

# --- commits ------------------------------------------------------------------------------

PARTS["o_counts"] = """
SELECT change_set_id, change_type, count(*) AS n, min(ordinal) AS first, CAST(sum(n_added) AS BIGINT) AS added,
       CAST(sum(n_removed) AS BIGINT) AS removed FROM code_changes GROUP BY change_set_id, change_type"""
PARTS["o_summary"] = """
SELECT change_set_id, CAST(sum(n) AS BIGINT) AS n_changes, CAST(sum(added) AS BIGINT) AS lines_added,
       CAST(sum(removed) AS BIGINT) AS lines_removed,
       list(CASE change_type WHEN 'modify' THEN 'Modified ' || n || ' files (+' || added || '/-' || removed || ' lines)'
              WHEN 'add' THEN 'Added ' || n || ' new files' WHEN 'delete' THEN 'Removed ' || n || ' files'
              ELSE 'Renamed ' || n || ' files' END ORDER BY first) AS summary
FROM o_counts GROUP BY change_set_id"""
BODIES["change_summary"] = """
SELECT change_set_id, n_changes, lines_added, lines_removed, array_to_string(summary, '; ') AS summary FROM o_summary"""
PARTS["o_scopes"] = f"""
SELECT change_set_id, CASE
         WHEN count(DISTINCT dir) = 1 AND min(dir_name) NOT IN ('.', '', 'src', 'lib') THEN min(dir_name)
         WHEN count(named) > 0 THEN arg_min(named, ordinal) FILTER (named IS NOT NULL)
         WHEN count(*) > 1 AND count(DISTINCT top) = 1 THEN min(top) END AS scope
FROM (SELECT change_set_id, ordinal, regexp_replace(file_path, '/?[^/]*$', '') AS dir,
             regexp_extract(file_path, '([^/]*)/[^/]*$', 1) AS dir_name,
             CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) END AS top,
             nullif(replace(regexp_extract(file_path, {rx(c.SCOPE_PATTERN)}, 0), '_', '-'), '') AS named
      FROM code_changes) AS p
GROUP BY change_set_id"""
BODIES["commit_scopes"] = "SELECT * FROM o_scopes"


def _type_of(description: str, step_type: str) -> str:
    words = " ".join(f"WHEN {has_any(f'lower({description})', w)} THEN {q(t)}" for t, w in c.COMMIT_TYPE_WORDS.items())
    by_step = " ".join(f"WHEN {q(s)} THEN {q(t)}" for s, t in c.COMMIT_TYPE_BY_STEP.items())
    return f"CASE {words} ELSE CASE {step_type} {by_step} ELSE 'refactor' END END"


BODIES["commit_types"] = f"SELECT plan_id, ordinal, {_type_of('description', 'type')} AS commit_type FROM plan_steps"
PARTS["o_semantic"] = """
SELECT change_set_id, list_slice(list_sort(list(DISTINCT semantic_change)), 1, 3) AS semantic
FROM code_changes WHERE semantic_change IS NOT NULL GROUP BY change_set_id"""
BODIES["semantic_changes"] = "SELECT change_set_id, array_to_string(semantic, ',') AS semantic FROM o_semantic"


def _top_lines(where: str, line: str, limit: int) -> str:
    return f"""
SELECT change_set_id, list_slice(list({line} ORDER BY {_priority} DESC, ordinal, stage, sub_ordinal), 1, {limit}) AS l
FROM o_found WHERE {where} GROUP BY change_set_id"""


_severe = "severity IN ('critical', 'high')"
PARTS["o_severe"] = _top_lines(_severe, "'- ' || type || ': ' || description", 3)
PARTS["o_breaking"] = _top_lines(f"type = 'api_change' AND {_severe}", "'  - ' || description", 2)
PARTS["o_headed"] = f"""
SELECT s.*, n_changes, lines_added, lines_removed, summary, scope, {_type_of('s.description', 's.type')} AS kind,
       regexp_replace(lower(s.description), '^({'|'.join(c.LEADING_VERBS)}) ', '') AS action,
       string_split(checks, ',') AS check_list
FROM commit_steps AS s JOIN o_summary AS c ON s.change_set_id = c.change_set_id
JOIN o_scopes AS p ON s.change_set_id = p.change_set_id"""
PARTS["o_words"] = """
SELECT *, string_split(action, ' ') AS parts, kind || coalesce('(' || scope || ')', '') || ': ' AS prefix,
       length(kind || '(' || coalesce(scope, 'None') || '): ') AS measured
FROM o_headed"""
PARTS["o_commits"] = f"""
SELECT w.plan_id, w.ordinal, w.id AS step_id, w.change_set_id,
       CASE WHEN commit_message <> '' THEN commit_message
            WHEN length(prefix || action) <= 72 THEN prefix || action
            ELSE prefix || array_to_string(list_slice(parts, 1, greatest(least(len(parts), 3), coalesce(list_max(list_filter(
                   range(1, len(parts) + 1), lambda k: measured + length(array_to_string(list_slice(parts, 1, k), ' ')) <= 72)), 0))),
                   ' ') || '...' END AS message,
       kind AS type, scope, b.l IS NOT NULL AS breaking_change, n_changes, lines_added, lines_removed,
       array_to_string(list_concat(list_concat(list_concat(
         CASE WHEN description IS DISTINCT FROM commit_message THEN ['- ' || description] ELSE [] END,
         list_concat([chr(10) || 'Changes:'], list_transform(list_concat(summary, coalesce(semantic, [])), lambda x: '- ' || x))),
         CASE WHEN checks <> '' THEN list_concat([chr(10) || 'Validation:'],
              list_transform(list_slice(check_list, 1, 3), lambda x: '- ' || x)) ELSE [] END),
         CASE WHEN v.l IS NOT NULL THEN list_concat([chr(10) || 'Risks addressed:'], v.l) ELSE [] END), chr(10)) AS body,
       array_to_string(list_concat(list_concat(
         CASE WHEN b.l IS NOT NULL THEN list_concat([{q(c.BREAKING_NOTICE)}], b.l) ELSE [] END,
         [chr(10) || 'Ref: ' || id]),
         CASE WHEN risk_level = 'high' AND rollback_strategy <> '' THEN [chr(10) || 'Rollback: ' || rollback_strategy]
              ELSE [] END), chr(10)) AS footer
FROM o_words AS w LEFT JOIN o_semantic AS m ON w.change_set_id = m.change_set_id
LEFT JOIN o_severe AS v ON w.change_set_id = v.change_set_id
LEFT JOIN o_breaking AS b ON w.change_set_id = b.change_set_id"""
BODIES["commit_records"] = "SELECT * FROM o_commits"
BODIES["commit_messages"] = """
SELECT plan_id, step_id, message || chr(10) || chr(10) || body || chr(10) || chr(10) || footer AS full_message FROM o_commits"""
_gate = f"(regexp_matches(message, {rx(c.HEADER_PATTERN)}) AND lines_added + lines_removed <= 1000)"
BODIES["commit_gate"] = f"SELECT plan_id, step_id, {_gate} AS passed FROM o_commits"
BODIES["commit_impact"] = """
SELECT plan_id, step_id, message, n AS files_changed, lines_added, lines_removed
FROM o_commits AS c JOIN (SELECT change_set_id, count(DISTINCT file_path) AS n FROM code_changes GROUP BY ALL) AS f
  ON c.change_set_id = f.change_set_id"""
PARTS["o_results"] = f"""
SELECT s.plan_id, s.ordinal, s.id AS step_id, s.change_set_id, coalesce({_gate}, true) AS success,
       CASE WHEN NOT {_gate} THEN 'Failed to commit: Commit verification failed' END AS error,
       coalesce(n_changes, 0) AS n_changes, coalesce(n_risks, 0) AS n_risks, coalesce(n_severe_risks, 0) AS n_severe_risks
FROM commit_steps AS s
LEFT JOIN (SELECT plan_id, step_id, message, lines_added, lines_removed, n_changes FROM o_commits) AS c
  ON s.plan_id = c.plan_id AND s.id = c.step_id
LEFT JOIN (SELECT change_set_id, count(*) AS n_risks, count(*) FILTER ({_severe}) AS n_severe_risks FROM o_found
           GROUP BY change_set_id) AS r ON s.change_set_id = r.change_set_id"""
BODIES["step_results"] = "SELECT * FROM o_results"
# A run ends with its first failure.
PARTS["o_executed"] = """
SELECT r.* FROM o_results AS r
WHERE NOT EXISTS (SELECT 1 FROM o_results AS f WHERE f.plan_id = r.plan_id AND NOT f.success AND f.ordinal < r.ordinal)"""
PARTS["o_run_steps"] = """
SELECT s.* FROM commit_steps AS s JOIN o_executed AS x ON s.plan_id = x.plan_id AND s.id = x.step_id"""
BODIES["execution_summary"] = """
SELECT plan_id, count(*) AS n_steps, count(*) FILTER (success) AS n_succeeded,
       CAST(sum(n_severe_risks) AS BIGINT) AS n_severe_risks FROM o_executed GROUP BY plan_id"""
BODIES["execution_progress"] = """
SELECT plan_id, step_id, position, total, position / total * 100 AS percent, n_severe_risks FROM (
  SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY ordinal) AS position,
         count(*) OVER (PARTITION BY plan_id) AS total,
         min(CASE WHEN NOT success THEN ordinal END) OVER (PARTITION BY plan_id) AS failed_at
  FROM o_results) AS r WHERE failed_at IS NULL OR ordinal < failed_at"""
BODIES["severity_report"] = """
SELECT s.id AS step_id, s.description, s.type, s.risk_level, r.severity,
       CASE r.severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 END AS severity_rank,
       coalesce(n, 0) AS n_risks
FROM commit_steps AS s LEFT JOIN (SELECT change_set_id, severity, count(*) AS n FROM o_found GROUP BY ALL) AS r
  ON s.change_set_id = r.change_set_id"""
BODIES["release_commits"] = """
SELECT plan_id, ordinal, message, array_to_string(list_filter(list_slice(string_split(body, chr(10)), 1, 3),
       lambda l: trim(l) <> ''), chr(10)) AS body_head FROM o_commits AS c
WHERE EXISTS (SELECT 1 FROM o_executed AS x WHERE x.plan_id = c.plan_id AND x.step_id = c.step_id AND x.success)"""


def _by_rule(value) -> str:
    return "CASE rule_id " + " ".join(f"WHEN {q(r.rule_id)} THEN {value(r)}" for r in c.RISK_RULES) + " END"


_tests = _by_rule(lambda r: "[" + ", ".join(map(q, r.tests)) + "]")
BODIES["regression_risks"] = f"""
SELECT change_set_id, {_priority} AS priority, ordinal, stage, sub_ordinal, rule_id, type, severity, description, component,
       {_by_rule(lambda r: q(r.mitigation))} AS mitigation,
       array_to_string(list_transform({_tests}, lambda t: replace(t, '{{}}', coalesce(subject, ''))), '; ') AS tests
FROM o_found"""
BODIES["release_risks"] = f"""
SELECT plan_id, position, type, severity, description, {_by_rule(lambda r: q(r.mitigation))} AS mitigation FROM (
  SELECT s.plan_id, r.*, CAST(row_number() OVER (PARTITION BY s.plan_id
           ORDER BY s.ordinal, {_priority.replace('severity', 'r.severity').replace('CASE type', 'CASE r.type')} DESC,
                    r.ordinal, r.stage, r.sub_ordinal) AS INTEGER) AS position
  FROM o_found AS r JOIN o_run_steps AS s ON r.change_set_id = s.change_set_id WHERE {_severe}) AS p
WHERE position <= 5"""
PARTS["o_suggestions"] = f"""
SELECT DISTINCT plan_id, replace(t, '{{}}', coalesce(subject, '')) AS suggestion FROM (
  SELECT s.plan_id, r.subject, unnest({_by_rule(lambda r: '[' + ', '.join(map(q, r.tests)) + ']')}) AS t
  FROM o_found AS r JOIN o_run_steps AS s ON r.change_set_id = s.change_set_id) AS u"""
BODIES["test_suggestions"] = "SELECT * FROM o_suggestions"
BODIES["first_test_suggestions"] = """
SELECT plan_id, suggestion, position FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY suggestion) AS INTEGER) AS position FROM o_suggestions) AS s
WHERE position <= 10"""

ORACLE = {name: with_views(body, PARTS) for name, body in BODIES.items()}
