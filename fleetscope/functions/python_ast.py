"""Python structure of source text, one Arrow batch at a time."""

from __future__ import annotations

import ast
import re
import sys
from collections import deque

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

# The small parsing functions travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


FACTS = {
    "error": "STRING",
    "complexity": "INT",
    "imports": "ARRAY<STRUCT<module: STRING, alias: STRING, type: STRING>>",
    "classes": "ARRAY<STRUCT<name: STRING, methods: ARRAY<STRING>, bases: ARRAY<STRING>, "
    "decorators: ARRAY<STRING>, line_number: INT>>",
    "functions": "ARRAY<STRUCT<name: STRING, args: ARRAY<STRING>, decorators: ARRAY<STRING>, returns: STRING, "
    "line_number: INT, complexity: INT>>",
}
SUMMARY = ["error", "complexity"]
_BRANCHES = frozenset({ast.If, ast.While, ast.For, ast.ExceptHandler})
# Node classes below which nothing is counted, and node fields holding no such nodes.
_LEAVES = (ast.Name, ast.Constant, ast.alias, ast.Global, ast.Nonlocal)
_PARENTS = frozenset(
    kind for kind in vars(ast).values()
    if isinstance(kind, type) and issubclass(kind, ast.AST) and kind._fields and not issubclass(kind, _LEAVES)
)
_PLAIN_FIELDS = {"ctx", "op", "ops", "id", "attr", "name", "names", "kind", "type_comment", "lineno"}
_FIELDS = {kind: [f for f in kind._fields if f not in _PLAIN_FIELDS] for kind in _PARENTS}
# Statement lists of each node class. Branches are statements or handlers and stand in these lists only.
_LISTS = ("body", "orelse", "finalbody", "handlers", "cases")
_STATEMENTS = {
    kind: lists for kind in _PARENTS
    if issubclass(kind, (ast.mod, ast.stmt, ast.excepthandler, ast.match_case)) and (lists := [f for f in kind._fields if f in _LISTS])
}
# No text without such a word holds an "and" or "or"; a digit may stand right before it.
_MAY_COMBINE = re.compile(r"(?<![^\W\d])(?:and|or)(?!\w)").search
_NOTED = _BRANCHES | {ast.BoolOp, ast.Import, ast.ImportFrom, ast.ClassDef, ast.FunctionDef}


def _dotted(node) -> str:
    tail = []
    while isinstance(node, ast.Attribute):
        tail.append(node.attr)
        node = node.value
    return ".".join([node.id if isinstance(node, ast.Name) else "unknown", *reversed(tail)])


def _imported(node) -> list[dict]:
    if isinstance(node, ast.Import):
        return [{"module": n.name, "alias": n.asname, "type": "import"} for n in node.names]
    origin = node.module or ""
    return [{"module": f"{origin}.{n.name}", "alias": n.asname, "type": "from_import"} for n in node.names]


def describe(tree: ast.AST) -> dict:
    """All facts of a module in one breadth-first visit.

    A branch counts towards the file and towards every plain function around
    it, so each queued node carries the functions it lies in.
    """
    found: dict = {"error": None, "complexity": 1, "imports": [], "classes": [], "functions": []}
    queue: deque = deque([(tree, ())])
    while queue:
        node, around = queue.popleft()
        kind = node.__class__
        if kind not in _NOTED:
            pass
        elif kind in _BRANCHES:
            found["complexity"] += 1
            for function in around:
                function["complexity"] += 1
        elif kind is ast.BoolOp:
            found["complexity"] += len(node.values) - 1
        elif kind is ast.Import or kind is ast.ImportFrom:
            found["imports"] += _imported(node)
        elif kind is ast.ClassDef:
            found["classes"].append({
                "name": node.name,
                "methods": [member.name for member in node.body if isinstance(member, ast.FunctionDef)],
                "bases": [_dotted(base) for base in node.bases],
                "decorators": [_dotted(mark) for mark in node.decorator_list],
                "line_number": node.lineno,
            })
        else:
            function = {
                "name": node.name,
                "args": [a.arg for a in node.args.args],
                "decorators": [_dotted(mark) for mark in node.decorator_list],
                "returns": _dotted(node.returns) if node.returns else None,
                "line_number": node.lineno,
                "complexity": 1,
            }
            found["functions"].append(function)
            around = (*around, function)
        for field in _FIELDS[kind]:
            value = getattr(node, field, None)
            if value.__class__ is list:
                queue.extend([(child, around) for child in value if child.__class__ in _PARENTS])
            elif value.__class__ in _PARENTS:
                queue.append((value, around))
    return found


def complexity(tree: ast.Module, text: str) -> int:
    """The complexity that :func:`describe` gives. Expressions are visited only if ``text`` may hold an ``and`` or ``or``."""
    total, queue = 1, [tree]
    if _MAY_COMBINE(text) is None:
        for node in queue:
            for field in _STATEMENTS[node.__class__]:
                for child in getattr(node, field):
                    kind = child.__class__
                    if kind in _STATEMENTS:
                        total += kind in _BRANCHES
                        queue.append(child)
        return total
    for node in queue:
        kind = node.__class__
        if kind in _BRANCHES:
            total += 1
        elif kind is ast.BoolOp:
            total += len(node.values) - 1
        for field in _FIELDS[kind]:
            value = getattr(node, field, None)
            if value.__class__ is list:
                queue.extend([child for child in value if child.__class__ in _PARENTS])
            elif value.__class__ in _PARENTS:
                queue.append(value)
    return total


def parse(source: bytes | None, summary: bool = False) -> dict:
    """Facts of one file, or with ``summary`` its complexity only; a file that does not parse yields only its ``error``."""
    if source is None:
        return {"error": "no content"}
    try:
        text = source.decode("utf-8")
        tree = ast.parse(text)
        return {"error": None, "complexity": complexity(tree, text)} if summary else describe(tree)
    except UnicodeDecodeError as problem:
        return {"error": f"not UTF-8: {problem.reason}"}
    except (SyntaxError, ValueError) as problem:
        return {"error": str(problem)}
    except (RecursionError, MemoryError) as problem:
        return {"error": f"too deeply nested: {type(problem).__name__}"}


def parser(fields: list[str]):
    """An Arrow-batched expression giving ``fields`` of each source as a struct.

    It is non-deterministic only to the optimizer: that keeps a filter on the
    result from being pushed below the call, which would parse every file twice.
    """

    summary = set(fields) <= set(SUMMARY)

    def parse_batch(sources: pd.Series) -> pd.DataFrame:
        facts = [parse(source, summary) for source in sources]
        frame = pd.DataFrame({name: pd.Series([f.get(name) for f in facts], dtype="object") for name in fields})
        return frame.astype({"complexity": "Int32"}) if "complexity" in fields else frame

    schema = ", ".join(f"{name} {FACTS[name]}" for name in fields)
    return F.pandas_udf(parse_batch, schema).asNondeterministic()
