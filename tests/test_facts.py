import ast

from helpers import rows

from fleetscope.functions import python_ast
from fleetscope.operators import facts
from fleetscope.sources import files as sources

SAMPLE = """
import csv
import sqlite3 as store
from fastapi import FastAPI

app = FastAPI()

class Ledger(dict):
    @property
    def total(self):
        return sum(v for v in self.values() if v > 0)

    async def refresh(self):
        while self.stale and self.open:
            await self.pull()

@app.post("/ledger/import")
@audited
def load(path):
    try:
        with open(path) as source:
            while row := source.readline():
                if not row.strip():
                    continue
                connection.execute("INSERT INTO entries SELECT item FROM staging")
    except OSError:
        return None
"""
FILES = "repo_id string, service string, path string, content string"


def files(spark, **contents):
    return spark.createDataFrame([("r", "s", path, text) for path, text in contents.items()], FILES)


def test_sample_structure(spark):
    found = facts.structure_facts(files(spark, sample=SAMPLE)).cache()
    assert rows(facts.imports(found), "module", "alias", "type") == [
        ("csv", None, "import"), ("fastapi.FastAPI", None, "from_import"), ("sqlite3", "store", "import")]
    assert [(r.name, r.methods) for r in facts.classes(found).collect()] == [("Ledger", ["total"])]
    assert rows(facts.functions(found), "name", "complexity") == [("load", 4), ("total", 1)]
    assert found.first().complexity == 6


def test_sample_text_facts(spark):
    found = facts.file_facts(files(spark, sample=SAMPLE)).cache()
    assert rows(facts.endpoints(found), "path", "method", "framework") == [("/ledger/import", "POST", "flask")]
    assert rows(facts.db_queries(found), "type", "operation", "table") == [("sql", "INSERT", "staging")]
    assert facts.external_dependencies(found).count() == 0


def test_file_that_does_not_parse_has_only_an_error(spark):
    broken = "@app.get('/x')\ndef import():\n    pass\n"
    row = facts.file_facts(files(spark, bad=broken)).first()
    assert row.error and row.complexity is None and row.endpoints is None
    text_only = facts.file_facts(files(spark, bad=broken), require_parse=False).first()
    assert text_only.error is None and text_only.endpoints[0].path == "/x"


def test_only_files_with_a_wanted_fact_are_parsed(spark):
    texts = {"api": "@app.get('/x')\ndef f():\n    if a and b:\n        pass\n", "plain": "x = 1\n", "bad": "@app.get('/y')\ndef import():\n", "none": None}
    given = files(spark, **texts)
    every, some = facts.file_facts(given).cache(), facts.file_facts(given, having=["endpoints", "db_queries"]).cache()
    assert rows(facts.endpoints(some)) == rows(facts.endpoints(every)) and facts.endpoints(some).count() == 1
    assert rows(some, "path", "complexity") == [("api", 3), ("bad", None), ("none", None), ("plain", None)]


def test_complexity_alone_is_that_of_all_facts():
    texts = [
        SAMPLE, "x = 1or 2\n", "x = f'{a and b or c} or d'\n", "android, order = 'a and b', 1  # or\n", "x = [a for a in b if c]\nlambda: 0 if x else 1\n",
        "async def f():\n    async for a in b:\n        for c in d:\n            pass\n    else:\n        while x:\n            pass\n",
        "try:\n    pass\nexcept* A:\n    if x:\n        pass\nelse:\n    for a in b: pass\nfinally:\n    with a:\n        if b: pass\n        elif c: pass\n",
        "match a:\n    case 1 if b:\n        if c: pass\n    case _:\n        while d: pass\n", "def broken(", "\x00", "class A:\n    class B:\n        def f(self):\n            if a: pass\n",
    ]
    for text in [*texts, *(t + "y = a or b\n" for t in texts)]:
        every, alone = python_ast.parse(text.encode()), python_ast.parse(text.encode(), summary=True)
        assert (alone["error"], alone.get("complexity")) == (every["error"], every.get("complexity"))


def test_endpoint_patterns(spark):
    code = (
        '@app.post("/a")\n@app.route("/m", methods=["GET"])\n@app.patch("/p")\n@router.delete(\'/b\')\n'
        '@api.resource("/c")\n@app.get ("/d")\n'
    )
    found = facts.endpoints(facts.file_facts(files(spark, f=code), require_parse=False))
    assert [(r.ordinal, r.path, r.method, r.framework) for r in found.orderBy("ordinal").collect()] == [
        (0, "/a", "POST", "flask"), (1, "/d", "GET", "flask"), (2, "/b", "DELETE", "fastapi"),
        (3, "/c", "GET", "flask-restful")]


def test_db_query_patterns(spark):
    code = (
        "select a, b from Users\nDELETE FROM t\ndelete  x from tabé\nINSERT\n INTO x SELECT y\nFROM z\n"
        "db.session.Commit()\nUser.objects.filter(a)\n"
    )
    found = facts.db_queries(facts.file_facts(files(spark, f=code), require_parse=False))
    # A single blank before FROM leaves nothing for the middle part: `DELETE FROM t` is no match.
    assert rows(found, "type", "operation", "table") == [
        ("django-orm", "filter", "unknown"), ("sql", "INSERT", "z"), ("sql", "delete", "tabé"),
        ("sql", "select", "Users"), ("sqlalchemy", "Commit", "unknown")]


def test_library_calls(spark):
    code = "import redis\nredis.Redis (host)\nboto3.client('s3')\nrequests.patch(u)\n"
    found = facts.external_dependencies(facts.file_facts(files(spark, f=code), require_parse=False))
    assert rows(found, "library") == [("boto3",), ("redis",)]


def plain_count(source):
    """Straightforward counts with ast.walk, to check the one-pass visit."""
    tree = ast.parse(source)
    branch = (ast.If, ast.While, ast.For, ast.ExceptHandler)
    total = 1 + sum(isinstance(n, branch) for n in ast.walk(tree))
    total += sum(len(n.values) - 1 for n in ast.walk(tree) if isinstance(n, ast.BoolOp))
    each = [
        (n.name, 1 + sum(isinstance(m, branch) for m in ast.walk(n)))
        for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)
    ]
    return total, each


def test_complexity_against_plain_count():
    for module in (ast, python_ast, facts, sources):
        with open(module.__file__, encoding="utf-8") as f:
            source = f.read()
        got = python_ast.describe(ast.parse(source))
        total, each = plain_count(source)
        assert got["complexity"] == total
        assert [(f["name"], f["complexity"]) for f in got["functions"]] == each


def test_names_and_async():
    source = (
        "@a.b.c\n@call()\nclass K(m.N, list[int]):\n    async def m(self): pass\n    def n(self, x, /, y, *, z=1) -> None: pass\n"
        "async def f():\n    def g() -> p.Q: pass\n    async for i in x:\n        if a and b and c: pass\n"
    )
    got = python_ast.describe(ast.parse(source))
    assert got["classes"] == [{"name": "K", "methods": ["n"], "bases": ["m.N", "unknown"],
                               "decorators": ["a.b.c", "unknown"], "line_number": 3}]
    assert [(f["name"], f["args"], f["returns"]) for f in got["functions"]] == [
        ("n", ["y"], "unknown"), ("g", [], "p.Q")]
    assert got["complexity"] == 4


def test_unreadable_sources():
    assert python_ast.parse(b"x = '\xff'")["error"].startswith("not UTF-8")
    assert python_ast.parse(b"x = 1\x00")["error"]
    assert python_ast.parse(b"(" * 5000)["error"]


def test_source_tree(spark, tmp_path):
    (tmp_path / "pkg" / "deep dir").mkdir(parents=True)
    (tmp_path / "pkg" / "deep dir" / "a+b.py").write_bytes(b"import os\r\nif 1: pass\r")
    (tmp_path / "pkg" / "bad.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "pkg" / "note.txt").write_text("no")
    tree = sources.read_source_tree(spark, str(tmp_path), "r")
    found = facts.structure_facts(tree)
    got = {r.path: r for r in found.collect()}
    assert set(got) == {"pkg/deep dir/a+b.py", "pkg/bad.py"}
    assert got["pkg/deep dir/a+b.py"].complexity == 2
    assert got["pkg/bad.py"].error
