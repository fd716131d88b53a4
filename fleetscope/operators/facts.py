"""Facts of source files.

A file is parsed once, in an Arrow-batched expression over its ``content``
column alone; everything else is a built-in expression on the same row. So the
gate "only files that parse have facts" costs no join, and ``content`` is
dropped before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import DB_QUERY_PATTERNS, ENDPOINT_PATTERNS, LIBRARY_CALL_PATTERNS
from ..functions import python_ast, text
from ..functions.arrays import explode_rows, inline_rows

SPAN_SEGMENTS = 8


def parsed(files: DataFrame, fields: list[str] | None = None, having: list[str] | None = None) -> DataFrame:
    """Adds ``ast``, a struct of ``fields``: error, complexity, imports, classes, functions; all if none are named.

    With ``having``, texts without any of these ``TEXT_FACTS`` are not handed to the parser. A filter in front of it would be
    moved into the scan, which may have few tasks; so the choice is part of the parser's input.
    """
    parse = python_ast.parser(list(python_ast.FACTS) if fields is None else fields)
    content = F.col("content")
    if having is not None:
        content = F.when(reduce(Column.__or__, [F.size(TEXT_FACTS[name](content)) > 0 for name in having]), content)
    return files.withColumn("ast", parse(content.cast("binary")))


def structure_facts(files: DataFrame, *fields: str) -> DataFrame:
    """One row per file with its parse error or its structure, or only ``fields`` of it; no text."""
    return parsed(files, list(fields) or None).drop("content").select("*", "ast.*").drop("ast")


def _keys(facts: DataFrame) -> list[str]:
    return [c for c in ("repo_id", "service", "path") if c in facts.columns]


def imports(facts: DataFrame) -> DataFrame:
    return inline_rows(facts, _keys(facts), "imports", "module")


def classes(facts: DataFrame) -> DataFrame:
    return inline_rows(facts, _keys(facts), "classes", "name")


def functions(facts: DataFrame) -> DataFrame:
    return inline_rows(facts, _keys(facts), "functions", "name")


def library_names(content: Column) -> Column:
    called = [F.when(content.rlike(text.pattern(p)), F.lit(name)) for name, p in LIBRARY_CALL_PATTERNS.items()]
    return F.array_compact(F.array(*called))


def declared_endpoints(content: Column) -> Column:
    """``array<struct<path, method, framework>>``, by framework, then by position."""
    families = []
    for framework, raw in ENDPOINT_PATTERNS.items():
        families.append(_declared(content, framework, text.pattern(raw)))
    return F.concat(*families)


def _declared(content: Column, framework: str, java: str) -> Column:
    def endpoint(match: Column) -> Column:
        verb = F.regexp_extract(match, java, 1)
        return F.struct(
            F.regexp_extract(match, java, 2).alias("path"),
            F.when(verb.isin("route", "resource"), "GET").otherwise(F.upper(verb)).alias("method"),
            F.lit(framework).alias("framework"),
        )

    return F.transform(F.regexp_extract_all(content, F.lit(java), F.lit(0)), endpoint)


def database_accesses(content: Column) -> Column:
    """``array<struct<type, operation, table>>``, by family, then by position."""
    families = []
    for family, raw in DB_QUERY_PATTERNS.items():
        families.append(_accesses(content, family, text.pattern(raw, ignore_case=True)))
    return F.concat(*families)


def _accesses(content: Column, family: str, java: str) -> Column:
    def access(match: Column) -> Column:
        table = F.regexp_extract(match, java, 2) if family == "sql" else F.lit("unknown")
        return F.struct(
            F.lit(family).alias("type"),
            F.regexp_extract(match, java, 1).alias("operation"),
            table.alias("table"),
        )

    return F.transform(F.regexp_extract_all(content, F.lit(java), F.lit(0)), access)


def without_declarations(content: Column) -> Column:
    """The text without its own route declarations, so that only calls are left."""
    for raw in ENDPOINT_PATTERNS.values():
        content = F.regexp_replace(content, F.lit(text.pattern(raw)), F.lit(""))
    return content


def mentioned_paths(content: Column) -> Column:
    """Distinct URL-path texts a file calls: from a slash to the next blank, quote or delimiter.

    What a file declares is not a call of it.
    """
    called = without_declarations(content)
    return F.array_distinct(F.regexp_extract_all(called, F.lit(r"""/[^\s'"`?#,;()]+"""), F.lit(0)))


#: Facts that patterns find in the text.
TEXT_FACTS = {
    "external_dependencies": library_names,
    "endpoints": declared_endpoints,
    "db_queries": database_accesses,
    "mentioned_paths": mentioned_paths,
}


def file_facts(files: DataFrame, require_parse: bool = True, having: list[str] | None = None) -> DataFrame:
    """One narrow row per file: everything the service-level jobs need.

    Files that do not parse keep their ``error`` and have null facts. With
    ``require_parse=False`` the text facts are taken from any language.

    With ``having``, names of ``TEXT_FACTS``, only files in whose text at least one of them is found are parsed; the others
    have null facts, and no ``error`` is given. Whoever lists these facts alone gets the same rows.
    """
    keys = _keys(files)
    if require_parse:
        files = parsed(files, python_ast.SUMMARY, having)
    else:
        files = files.withColumn("ast", F.struct(F.lit(None).cast("string").alias("error"), F.lit(1).alias("complexity")))
    ok = F.col("ast.error").isNull()
    content = F.col("content")
    return files.select(
        *keys,
        *(["ast.error"] if having is None else []),
        F.when(ok, F.col("ast.complexity")).alias("complexity"),
        *[F.when(ok, fact(content)).alias(name) for name, fact in TEXT_FACTS.items()],
    )


def endpoints(facts: DataFrame) -> DataFrame:
    keys = [c for c in _keys(facts) if c != "path"]
    file_path = F.col("path").alias("file_path")
    numbered = facts.select(*keys, file_path, F.posexplode_outer("endpoints").alias("ordinal", "e"))
    return numbered.filter(F.col("ordinal").isNotNull()).select(*keys, "file_path", "ordinal", "e.*")


def db_queries(facts: DataFrame) -> DataFrame:
    return inline_rows(facts, _keys(facts), "db_queries", "type")


def external_dependencies(facts: DataFrame) -> DataFrame:
    """Libraries called, distinct per file."""
    return explode_rows(facts, _keys(facts), "external_dependencies", "library")
