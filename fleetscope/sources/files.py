"""Source trees, requested files, and the services files belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import SERVICE_CODE_SUFFIXES, SERVICE_LAYOUTS
from ..functions import text
from ..functions.arrays import explode_rows, inline_rows
from ..operators.facts import file_facts

#: Up to so many requested paths are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_REQUESTS = 1_000_000


def read_source_tree(spark: SparkSession, root: str, repo_id: str, glob: str = "*.py") -> DataFrame:
    """Files below ``root`` matching ``glob``: ``repo_id, path, content``.

    Paths are relative to ``root``; line ends are normalised as text-mode
    reading does. Bytes are left as they are, so bad UTF-8 becomes a parse error
    of that file and never a failed task.
    """
    base = root.rstrip("/") + "/"
    files = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(root)
    )
    location = F.call_function("url_decode", F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(
        F.lit(repo_id).alias("repo_id"),
        F.substring_index(location, base, -1).alias("path"),
        text.unix_newlines(F.col("value")).alias("content"),
    )


def requested_files(requested: DataFrame, facts: DataFrame) -> DataFrame:
    """Every requested path with its facts, or the reason it has none."""
    known = facts.withColumn("found", F.lit(True))
    joined = requested.join(known, ["repo_id", "path"], "left")
    error = (
        F.when(F.col("found").isNull(), F.concat(F.lit("File not found: "), "path"))
        .when(F.col("error").isNotNull(), F.concat(F.lit("Syntax error in "), "path", F.lit(": "), "error"))
    )
    return joined.withColumn("error", error).drop("found")


def requested_file_facts(requested: DataFrame, files: DataFrame, broadcast_paths: int = BROADCAST_REQUESTS) -> DataFrame:
    """:func:`requested_files` from the texts: only files that are asked for are parsed."""
    wanted = requested.select("repo_id", "path").distinct()
    few = wanted.limit(broadcast_paths + 1).count() <= broadcast_paths
    texts = files.join(F.broadcast(wanted) if few else wanted, ["repo_id", "path"], "left_semi")
    return requested_files(requested, file_facts(texts))


def _layout_patterns() -> list[str]:
    return ["^(" + layout.replace("*", "[^/]*") + ")/" for layout in SERVICE_LAYOUTS]


def discover_services(files: DataFrame) -> DataFrame:
    """``repo_id, service, svc_path`` from the paths of code files.

    Only ``repo_id`` and ``path`` are read. Partial aggregation leaves a few rows
    per repository and task, however many files a repository holds.
    """
    path = F.col("path")
    is_code = path.endswith(SERVICE_CODE_SUFFIXES[0])
    for suffix in SERVICE_CODE_SUFFIXES[1:]:
        is_code = is_code | path.endswith(suffix)
    candidates = F.array_compact(F.array(*[
        F.when(path.rlike(pattern), F.struct(F.lit(rank).alias("rank"), F.regexp_extract(path, pattern, 1).alias("svc_path")))
        for rank, pattern in enumerate(_layout_patterns())
    ]))
    directories = (
        inline_rows(files.filter(is_code), ["repo_id"], candidates, "svc_path")
        .withColumn("name", F.substring_index("svc_path", "/", -1))
        .filter(~F.col("name").startswith("."))
    )
    service = F.replace(F.replace("name", F.lit("-service")), F.lit("-api"))
    return (
        directories.withColumn("service", service)
        .groupBy("repo_id", "service")
        .agg(F.max(F.struct("rank", "svc_path")).alias("last"))
        .select("repo_id", "service", "last.svc_path")
    )


def _ancestors(parts: Column) -> Column:
    """Directories above a file, from the path segments (a column: it is read once per directory)."""
    depth = F.size(parts)
    return F.when(
        depth > 1,
        F.transform(F.sequence(F.lit(1), depth - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
    )


def assign_services(files: DataFrame, service_map: DataFrame) -> DataFrame:
    """Adds ``service`` to files (or file facts) lying below a mapped path.

    A file under two mapped paths belongs to both. The prefix test is an
    equi-join on the ancestor directories of each file, so it needs no nested
    loop; pass facts rather than text, which keeps the shuffled rows narrow.
    """
    mapped = service_map.select("repo_id", "service", F.regexp_replace("svc_path", "/+$", "").alias("svc_path"))
    split = files.withColumn("parts", F.split("path", "/"))
    below = explode_rows(split, ["*"], _ancestors(F.col("parts")), "svc_path").drop("parts")
    return below.join(mapped, ["repo_id", "svc_path"]).drop("svc_path")
