"""Commit and release metadata of change sets.

A commit step row names its ``change_set_id``. All figures of a change set come
from one partial aggregation, so a hot change set is reduced before the shuffle;
lists are bounded top-n picks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalogue import (
    BREAKING_NOTICE,
    COMMIT_LINE_LIMIT,
    COMMIT_TYPE_BY_STEP,
    COMMIT_TYPE_WORDS,
    HEADER_LIMIT,
    HEADER_MIN_WORDS,
    HEADER_PATTERN,
    LEADING_VERBS,
    SCOPE_PATTERN,
    SCOPELESS_DIRECTORIES,
    SEVERITIES,
)
from ..functions import text
from .positions import running_positions
from .risks import breaking, first_risks, severe, with_guidance

_SUMMARISED = {"modify": None, "add": ("Added ", " new files"), "delete": ("Removed ", " files"), "rename": ("Renamed ", " files")}


def lines_changed(side: str) -> Column:
    return F.coalesce(F.element_at("line_changes", side), F.lit(0))


def commit_type(description: Column, step_type: Column) -> Column:
    lowered = F.lower(description)
    by_words = [F.when(text.contains_any(lowered, words), F.lit(kind)) for kind, words in COMMIT_TYPE_WORDS.items()]
    by_step = F.lit("refactor")
    for name, kind in COMMIT_TYPE_BY_STEP.items():
        by_step = F.when(F.lower(step_type) == name, kind).otherwise(by_step)
    return F.coalesce(*by_words, by_step)


def change_set_summary(changes: DataFrame) -> DataFrame:
    """One row per change set: counts per change type, line sums, and what the scope needs."""
    segments = text.path_segments(F.col("file_path"))
    rooted = F.startswith("file_path", F.lit("/"))
    depth = F.size("segments")
    normal = F.concat(F.when(F.col("rooted"), "/").otherwise(""), F.array_join("segments", "/"))
    shown = F.replace(F.regexp_extract("normal", text.pattern(SCOPE_PATTERN), 0), F.lit("_"), F.lit("-"))
    top = F.when(F.col("rooted") & (depth > 0), "/").when(depth > 1, F.get("segments", F.lit(0)))
    located = (
        changes.select(
            "change_set_id", "ordinal", "change_type", lines_changed("added").alias("added"),
            lines_changed("removed").alias("removed"), segments.alias("segments"), rooted.alias("rooted"),
        )
        .withColumn("normal", normal)
        .select(
            "change_set_id", "ordinal", "change_type", "added", "removed",
            F.struct("rooted", F.array_join(F.slice("segments", 1, F.greatest(depth - 1, F.lit(0))), "/").alias("dir")).alias("parent"),
            F.coalesce(F.when(depth > 1, F.get("segments", depth - 2)), F.lit("")).alias("parent_name"),
            top.alias("top"),
            F.when(shown != "", F.struct("ordinal", shown.alias("text"))).alias("named"),
        )
    )
    kinds = []
    for kind in _SUMMARISED:
        is_kind = F.col("change_type") == kind
        kinds += [F.count_if(is_kind).alias(f"n_{kind}"), F.min(F.when(is_kind, F.col("ordinal"))).alias(f"first_{kind}")]
    modified = F.col("change_type") == "modify"
    return located.groupBy("change_set_id").agg(
        F.count("*").alias("n_changes"),
        F.sum("added").alias("lines_added"),
        F.sum("removed").alias("lines_removed"),
        F.coalesce(F.sum(F.when(modified, F.col("added"))), F.lit(0)).alias("modified_added"),
        F.coalesce(F.sum(F.when(modified, F.col("removed"))), F.lit(0)).alias("modified_removed"),
        *kinds,
        F.min("parent").alias("min_parent"), F.max("parent").alias("max_parent"), F.min("parent_name").alias("parent_name"),
        F.min("top").alias("min_top"), F.max("top").alias("max_top"),
        F.min("named").alias("named"),
    )


def scope() -> Column:
    """Scope of a :func:`change_set_summary` row: common directory, service name, or common top directory."""
    same_dir = (F.col("min_parent") == F.col("max_parent")) & ~F.col("parent_name").isin(SCOPELESS_DIRECTORIES)
    return F.coalesce(
        F.when(same_dir, F.col("parent_name")),
        F.col("named.text"),
        F.when((F.col("n_changes") > 1) & (F.col("min_top") == F.col("max_top")), F.col("min_top")),
    )


def header(description: Column, commit_message: Column, kind: Column, scope_text: Column) -> Column:
    lowered = F.lower(description)
    verb = F.regexp_extract(lowered, "^(" + "|".join(LEADING_VERBS) + ") ", 0)
    action = F.substring(lowered, F.length(verb) + 1, F.length(lowered))
    prefix = F.concat(kind, F.coalesce(F.concat(F.lit("("), scope_text, F.lit(")")), F.lit("")), F.lit(": "))
    # The measured prefix names a missing scope "None"; the written one leaves it out.
    measured = F.length(kind) + F.coalesce(F.length(scope_text), F.lit(4)) + 4
    parts = text.words(action)
    start = F.struct(F.lit(-1).alias("length"), F.lit(0).alias("kept"))

    def take(state: Column, word: Column) -> Column:
        length = state["length"] + 1 + F.length(word)
        fits = measured + length <= HEADER_LIMIT
        return F.struct(length.alias("length"), F.when(fits, state["kept"] + 1).otherwise(state["kept"]).alias("kept"))

    fitting = F.aggregate(parts, start, take, lambda state: state["kept"])
    kept = F.greatest(fitting, F.least(F.size(parts), F.lit(HEADER_MIN_WORDS)))
    shortened = F.concat(prefix, F.array_join(F.slice(parts, 1, kept), " "), F.lit("..."))
    full = F.concat(prefix, action)
    written = F.when(F.length(full) > HEADER_LIMIT, shortened).otherwise(full)
    return F.coalesce(F.nullif(commit_message, F.lit("")), written)


def change_summary_lines() -> Column:
    """Summary lines of a :func:`change_set_summary` row, in order of first appearance."""
    entries = []
    for kind, words in _SUMMARISED.items():
        n = F.col(f"n_{kind}").cast("string")
        if words:
            line = F.concat(F.lit(words[0]), n, F.lit(words[1]))
        else:
            line = F.concat(F.lit("Modified "), n, F.lit(" files (+"), F.col("modified_added").cast("string"), F.lit("/-"),
                            F.col("modified_removed").cast("string"), F.lit(" lines)"))
        entries.append(F.when(F.col(f"n_{kind}") > 0, F.struct(F.col(f"first_{kind}").alias("first"), line.alias("line"))))
    ordered = F.sort_array(F.array_compact(F.array(*entries)))
    return F.transform(ordered, lambda e: e["line"])


def first_semantic_changes(changes: DataFrame, limit: int = 3) -> DataFrame:
    """The first distinct semantic changes of a change set, in text order."""
    distinct = changes.select("change_set_id", F.explode("semantic_changes").alias("text")).distinct()
    order = Window.partitionBy("change_set_id").orderBy("text")
    first = distinct.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    return first.groupBy("change_set_id").agg(F.sort_array(F.collect_list("text")).alias("semantic"))


def _first_lines(risks: DataFrame, condition: Column, line: Column, limit: int, name: str) -> DataFrame:
    chosen = first_risks(risks.filter(condition), ["change_set_id"], limit)
    listed = chosen.groupBy("change_set_id").agg(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("l"))
    return listed.select("change_set_id", F.transform("l", lambda e: e["line"]).alias(name))


def _body(listed_risks: Column) -> Column:
    summary = F.concat(change_summary_lines(), F.coalesce("semantic", F.array().cast("array<string>")))
    checks = F.slice(F.coalesce("validation_steps", F.array().cast("array<string>")), 1, 3)

    def section(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.array(F.lit(title)), F.transform(items, lambda i: F.concat(F.lit("- "), i))))

    parts = F.flatten(F.array_compact(F.array(
        F.when(~F.col("description").eqNullSafe(F.col("commit_message")), F.array(F.concat(F.lit("- "), "description"))),
        section("\nChanges:", summary),
        section("\nValidation:", checks),
        section("\nRisks addressed:", listed_risks),
    )))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))


def _footer(breaking_lines: Column) -> Column:
    parts = F.flatten(F.array_compact(F.array(
        F.when(F.size(breaking_lines) > 0, F.concat(F.array(F.lit(BREAKING_NOTICE)),
               F.transform(breaking_lines, lambda d: F.concat(F.lit("  - "), d)))),
        F.when(F.length("id") > 0, F.array(F.concat(F.lit("\nRef: "), "id"))),
        F.when((F.col("risk_level") == "high") & (F.length("rollback_strategy") > 0),
               F.array(F.concat(F.lit("\nRollback: "), "rollback_strategy"))),
    )))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))


def commit_records(steps: DataFrame, changes: DataFrame, risks: DataFrame) -> DataFrame:
    """One commit per step that has changes: header, type, scope, flag, body, footer.

    The files of a commit are the rows of its change set.
    """
    severe_lines = _first_lines(risks, severe(), F.concat("type", F.lit(": "), "description"), 3, "severe")
    breaking_lines = _first_lines(risks, breaking(), F.col("description"), 2, "breaking")
    joined = (
        steps.join(change_set_summary(changes), "change_set_id")
        .join(first_semantic_changes(changes), "change_set_id", "left")
        .join(severe_lines, "change_set_id", "left")
        .join(breaking_lines, "change_set_id", "left")
        .withColumn("kind", commit_type(F.col("description"), F.col("type")))
        .withColumn("scope", scope())
    )
    return joined.select(
        "plan_id", "ordinal", F.col("id").alias("step_id"), "change_set_id",
        header(F.col("description"), F.col("commit_message"), F.col("kind"), F.col("scope")).alias("message"),
        F.col("kind").alias("type"), "scope",
        F.col("breaking").isNotNull().alias("breaking_change"),
        "n_changes", "lines_added", "lines_removed",
        _body(F.coalesce("severe", F.array().cast("array<string>"))).alias("body"),
        _footer(F.coalesce("breaking", F.array().cast("array<string>"))).alias("footer"),
    )


def full_message() -> Column:
    """Header, body and footer of a commit record; absent parts leave no gap."""
    return F.concat_ws("\n\n", "message", F.nullif("body", F.lit("")), F.nullif("footer", F.lit("")))


def passes_gate() -> Column:
    return F.col("message").rlike(text.pattern(HEADER_PATTERN)) & (
        F.col("lines_added") + F.col("lines_removed") <= COMMIT_LINE_LIMIT
    )


def step_results(steps: DataFrame, commits: DataFrame, risks: DataFrame) -> DataFrame:
    """Outcome per step: success, or the reason its commit is refused."""
    graded = commits.select("plan_id", "step_id", "n_changes", passes_gate().alias("passed"))
    found = risks.groupBy("change_set_id").agg(
        F.count("*").alias("n_risks"), F.count_if(severe()).alias("n_severe_risks")
    )
    joined = (
        steps.select("plan_id", "ordinal", F.col("id").alias("step_id"), "change_set_id")
        .join(graded, ["plan_id", "step_id"], "left")
        .join(found, "change_set_id", "left")
    )
    success = F.coalesce("passed", F.lit(True))
    return joined.select(
        "plan_id", "ordinal", "step_id", "change_set_id", success.alias("success"),
        F.when(~success, "Failed to commit: Commit verification failed").alias("error"),
        F.coalesce("n_changes", F.lit(0)).alias("n_changes"),
        F.coalesce("n_risks", F.lit(0)).alias("n_risks"),
        F.coalesce("n_severe_risks", F.lit(0)).alias("n_severe_risks"),
    )


def executed(results: DataFrame) -> DataFrame:
    """Results of a run, which stops at its first failure: up to and with that step."""
    failure = results.filter(~F.col("success")).groupBy("plan_id").agg(F.min("ordinal").alias("failed_at"))
    reached = F.col("failed_at").isNull() | (F.col("ordinal") <= F.col("failed_at"))
    return results.join(failure, "plan_id", "left").filter(reached).drop("failed_at")


def execution_summary(results: DataFrame) -> DataFrame:
    """Counts over the executed steps."""
    return executed(results).groupBy("plan_id").agg(
        F.count("*").alias("n_steps"),
        F.count_if(F.col("success")).alias("n_succeeded"),
        F.sum("n_severe_risks").alias("n_severe_risks"),
    )


def execution_progress(results: DataFrame) -> DataFrame:
    """Progress after each step, up to the first failure of the plan."""
    failure = results.filter(~F.col("success")).groupBy("plan_id").agg(F.min("ordinal").alias("failed_at"))
    placed = running_positions(results, "plan_id", "ordinal").join(failure, "plan_id", "left")
    return placed.filter(F.col("failed_at").isNull() | (F.col("ordinal") < F.col("failed_at"))).select(
        "plan_id", "step_id", "position", "total",
        (F.col("position") / F.col("total") * 100).alias("percent"), "n_severe_risks",
    )


def commit_impact(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Distinct files and lines per commit; the affected files are the change rows."""
    per_file = changes.select(
        "change_set_id", "file_path", lines_changed("added").alias("added"), lines_changed("removed").alias("removed")
    ).groupBy("change_set_id", "file_path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    stats = per_file.groupBy("change_set_id").agg(
        F.count("*").alias("files_changed"), F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed")
    )
    return commits.drop("lines_added", "lines_removed").join(stats, "change_set_id")


def severity_report(steps: DataFrame, risks: DataFrame) -> DataFrame:
    """Risks per step and severity, from critical to low; steps without risks keep one empty row.

    The risks themselves, with mitigation and tests, are the rows of the risk table.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")).cast("int")
    grouped = risks.filter(F.col("severity").isin(SEVERITIES)).groupBy("change_set_id", "severity").agg(
        F.count("*").alias("n_risks")
    )
    named = steps.select(F.col("id").alias("step_id"), "change_set_id", "description", "type", "risk_level")
    return named.join(grouped, "change_set_id", "left").select(
        "step_id", "description", "type", "risk_level", "severity", rank.alias("severity_rank"),
        F.coalesce("n_risks", F.lit(0)).alias("n_risks"),
    )


def release_commits(commits: DataFrame, results: DataFrame) -> DataFrame:
    """Headers of the commits a run made with the first body lines, blank ones dropped."""
    made = executed(results).filter("success").select("plan_id", "step_id")
    head = F.filter(F.slice(F.split("body", "\n"), 1, 3), lambda l: text.strip(l) != "")
    return commits.join(made, ["plan_id", "step_id"], "left_semi").select("plan_id", "ordinal", "message", F.array_join(head, "\n").alias("body_head"))


def _planned_risks(steps: DataFrame, risks: DataFrame) -> DataFrame:
    placed = steps.select("plan_id", F.col("ordinal").alias("step_ordinal"), "change_set_id")
    return risks.join(placed, "change_set_id")


def executed_steps(steps: DataFrame, results: DataFrame) -> DataFrame:
    """The rows of ``steps`` that a run came to."""
    reached = executed(results).select("plan_id", F.col("step_id").alias("id"))
    return steps.join(reached, ["plan_id", "id"], "left_semi")


def release_risks(steps: DataFrame, risks: DataFrame, limit: int = 5) -> DataFrame:
    """First critical and high risks of a plan's (executed) steps, in step order, with mitigation."""
    # No step contributes more than the limit, so a change set is cut before the join.
    per_step = first_risks(risks.filter(severe()), ["change_set_id"], limit).drop("position")
    chosen = first_risks(_planned_risks(steps, per_step), ["plan_id"], limit, before=("step_ordinal",))
    first = with_guidance(chosen)
    return first.select("plan_id", "position", "type", "severity", "description", "mitigation")


def test_suggestions(steps: DataFrame, risks: DataFrame) -> DataFrame:
    """Distinct test suggestions per plan."""
    # Suggestions follow from rule and subject: make those distinct before joining and expanding them.
    per_set = risks.select("change_set_id", "rule_id", "subject").distinct()
    per_plan = _planned_risks(steps, per_set).select("plan_id", "rule_id", "subject").distinct()
    return with_guidance(per_plan).select("plan_id", F.explode("test_suggestions").alias("suggestion")).distinct()


def first_test_suggestions(steps: DataFrame, risks: DataFrame, limit: int = 10) -> DataFrame:
    order = Window.partitionBy("plan_id").orderBy("suggestion")
    numbered = test_suggestions(steps, risks).withColumn("position", F.row_number().over(order))
    return numbered.filter(F.col("position") <= limit)
