"""Regression risks of code changes.

All rules that look at one change are evaluated in a single scan: the diff is
split once, each rule contributes a conditional struct, and the surviving
structs are exploded. The diff itself never reaches a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..catalogue import (
    AUTH_WORDS,
    BLOCKING_WORDS,
    CONDITION_WORDS,
    DEPENDENCY_WORDS,
    DIFF_ROUTE_PATTERNS,
    EXCEPTION_WORDS,
    INTERFACE_WORDS,
    LARGE_CHANGE_SET,
    LOOP_WORDS,
    QUERY_WORDS,
    RETURN_WORDS,
    RISK_BY_ID,
    RISK_RULES,
    RISK_TYPE_SCORES,
    SECRET_PATTERNS,
    SEVERITY_SCORES,
    SQL_BUILDING_PATTERNS,
    SQL_FSTRING_PATTERN,
)
from ..functions import diffs, text
from ..functions.arrays import inline_rows

RISK_COLUMNS = [
    "change_set_id", "ordinal", "stage", "sub_ordinal", "rule_id", "type", "severity",
    "description", "subject", "component",
]
_EMITTED = T.ArrayType(
    T.StructType([
        T.StructField("stage", T.IntegerType()),
        T.StructField("sub_ordinal", T.IntegerType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("subject", T.StringType()),
    ])
)


def _describe(rule_id: str, subject: Column | None) -> Column:
    before, hole, after = RISK_BY_ID[rule_id].description.partition("{}")
    return F.concat(F.lit(before), subject, F.lit(after)) if hole else F.lit(before)


def _risk(rule_id: str, shown: Column | None = None, subject: Column | None = None,
          sub: Column | int = 0, severity: Column | None = None) -> Column:
    rule = RISK_BY_ID[rule_id]
    return F.struct(
        F.lit(rule.stage).alias("stage"),
        (F.lit(sub) if isinstance(sub, int) else sub).cast("int").alias("sub_ordinal"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(rule.type).alias("type"),
        (F.lit(rule.severity) if severity is None else severity).alias("severity"),
        _describe(rule_id, shown).alias("description"),
        (F.lit(None).cast("string") if subject is None else subject).alias("subject"),
    )


def split_diffs(changes: DataFrame) -> DataFrame:
    """Adds ``removed`` and ``added``, the line arrays of each diff."""
    return (
        changes.withColumn("lines", F.split("diff", "\n"))
        .withColumn("removed", diffs.marked_lines(F.col("lines"), "-"))
        .withColumn("added", diffs.marked_lines(F.col("lines"), "+"))
        .drop("lines")
    )


def diff_lines(changes: DataFrame) -> DataFrame:
    """One row per removed (``-``) or added (``+``) line."""
    sides = F.concat(
        F.transform("removed", lambda l, i: F.struct(F.lit("-").alias("side"), i.alias("position"), l.alias("line"))),
        F.transform("added", lambda l, i: F.struct(F.lit("+").alias("side"), i.alias("position"), l.alias("line"))),
    )
    return inline_rows(split_diffs(changes), ["change_set_id", "ordinal"], sides, "side")


def _with_parameter_changes(split: DataFrame) -> DataFrame:
    both = F.contains("removed_text", F.lit("def")) & F.contains("added_text", F.lit("def"))
    return (
        split.withColumn("definitions", F.when(both, diffs.ordered_definitions(F.col("removed"), F.col("added"))))
        .withColumn("definitions", diffs.last_definitions(F.col("definitions")))
        .withColumn("parameter_changes", diffs.parameter_changes(F.col("definitions")))
        .drop("definitions")
    )


def _joined_text(split: DataFrame) -> DataFrame:
    return split.withColumns({
        "removed_text": F.array_join("removed", "\n"),
        "added_text": F.array_join("added", "\n"),
    })


def function_signatures(changes: DataFrame) -> DataFrame:
    """Last parameter list per (change, side, function)."""
    split = _joined_text(split_diffs(changes))
    ordered = split.withColumn("definitions", diffs.ordered_definitions(F.col("removed"), F.col("added")))
    kept = diffs.last_definitions(F.col("definitions"))
    last = inline_rows(ordered, ["change_set_id", "ordinal"], kept, "name")
    return last.select(
        "change_set_id", "ordinal",
        F.when(F.col("side") == 0, "-").otherwise("+").alias("side"),
        F.col("name").alias("function"), "params",
    )


def parameter_changes(changes: DataFrame) -> DataFrame:
    """Functions whose parameter list differs between the sides of a diff."""
    edited = changes.filter(F.col("change_type").isin("modify", "delete"))
    split = _with_parameter_changes(_joined_text(split_diffs(edited)))
    return inline_rows(split, ["change_set_id", "ordinal", "file_path"], "parameter_changes", "function")


def _first_matching(lines: Column, java_pattern: str) -> Column:
    return F.get(F.filter(lines, lambda l: l.rlike(java_pattern)), F.lit(0))


def _quoted(joined: Column) -> Column:
    return text.contains_any(joined, ["'", '"'])


def _found(joined: Column, raw: str) -> Column:
    return joined.rlike(text.pattern(raw, ignore_case=True, one_line=True))


def _edit_rules() -> list[Column]:
    removed, added = F.col("removed"), F.col("added")
    gone, new = F.col("removed_text"), F.col("added_text")
    rules = []
    for family, raw in enumerate(DIFF_ROUTE_PATTERNS):
        routes = text.pattern(raw, one_line=True)
        first = text.strip(_first_matching(removed, text.pattern(raw)))
        rules.append(
            F.when(
                _quoted(gone) & gone.rlike(routes),
                F.when(new.rlike(routes), _risk("R02", F.col("file_path"), sub=family))
                .otherwise(_risk("R01", first, subject=first, sub=family)),
            )
        )
    # Each pattern needs its literal character; the substring test is far cheaper.
    built = F.lit(False)
    for needed, raw in zip(["(", "%", "+"], SQL_BUILDING_PATTERNS):
        built = built | (F.contains(new, F.lit(needed)) & _found(new, raw))
    secret = F.lit(False)
    for raw in SECRET_PATTERNS:
        secret = secret | _found(new, raw)
    secret = F.contains(new, F.lit("=")) & _quoted(new) & secret
    returns = [F.filter(side, lambda l: text.contains_any(l, RETURN_WORDS)) for side in (removed, added)]
    conditions = {
        "R04": text.contains_any(gone, CONDITION_WORDS) & text.contains_any(new, CONDITION_WORDS),
        "R05": (text.contains_any(gone, RETURN_WORDS) | text.contains_any(new, RETURN_WORDS))
        & (returns[0] != returns[1]),
        "R06": text.contains_any(gone, EXCEPTION_WORDS) | text.contains_any(new, EXCEPTION_WORDS),
        "R07": text.contains_any(new, LOOP_WORDS)
        & (diffs.count_lines_with(added, LOOP_WORDS) > diffs.count_lines_with(removed, LOOP_WORDS)),
        "R08": text.contains_any(new, QUERY_WORDS)
        & (diffs.count_lines_with(added, QUERY_WORDS) > diffs.count_lines_with(removed, QUERY_WORDS)),
        "R09": F.contains(new, F.lit("async ")) & text.contains_any(new, BLOCKING_WORDS),
        "R10": built,
        "R10b": F.contains(new, F.lit("{")) & _found(new, SQL_FSTRING_PATTERN),
        "R11": text.contains_any(gone, AUTH_WORDS) & ~text.contains_any(new, AUTH_WORDS),
        "R12": secret,
    }
    for rule_id, condition in conditions.items():
        sub = 1 if rule_id == "R10b" else 0
        rules.append(F.when(condition, _risk(rule_id, sub=sub)))
    return rules


def change_risks(changes: DataFrame) -> DataFrame:
    """One row per risk a single change raises. Works on streams as well."""
    edited = F.col("change_type").isin("modify", "delete")
    # An added or renamed file needs no diff lines: its diff is not split.
    looked_at = changes.select(
        "change_set_id", "ordinal", "file_path", "change_type",
        F.when(F.col("change_type") == "add", text.contains_any(F.col("diff"), DEPENDENCY_WORDS)).alias("brings_in"),
        F.when(edited, F.col("diff")).alias("diff"),
    )
    split = _with_parameter_changes(_joined_text(split_diffs(looked_at)))
    signature_rules = F.transform(
        "parameter_changes",
        lambda c, i: _risk(
            "R03", c["function"], subject=c["function"], sub=i,
            severity=F.when(F.size(c["removed_params"]) > 0, "high").otherwise("medium"),
        ),
    )
    from_edit = F.concat(
        F.array_compact(F.array(*_edit_rules())).cast(_EMITTED),
        F.coalesce(signature_rules.cast(_EMITTED), F.array().cast(_EMITTED)),
    )
    emitted = (
        F.when(edited, from_edit)
        .when(F.col("brings_in"), F.array(_risk("R13")).cast(_EMITTED))
        .when(F.col("change_type") == "rename", F.array(_risk("R14", F.col("file_path"))).cast(_EMITTED))
    )
    found = inline_rows(split, ["change_set_id", "ordinal", F.col("file_path").alias("component")], emitted, "rule_id")
    return found.select(*RISK_COLUMNS)


def interface_components(changes: DataFrame) -> DataFrame:
    """Distinct modified files per change set whose diff mentions an interface."""
    touched = changes.filter((F.col("change_type") == "modify") & text.contains_any(F.col("diff"), INTERFACE_WORDS))
    return touched.select("change_set_id", "file_path").distinct()


def change_set_risks(changes: DataFrame) -> DataFrame:
    """Risks of a whole change set: several interfaces modified, many files changed.

    ``n_components`` counts what is affected; the members are the rows of
    :func:`interface_components` and of the change set itself, so no array grows
    with the data.
    """
    interface = (F.col("change_type") == "modify") & text.contains_any(F.col("diff"), INTERFACE_WORDS)
    paths = (
        changes.select("change_set_id", F.when(interface, F.col("file_path")).alias("path"))
        .groupBy("change_set_id", "path").agg(F.count("*").alias("n"))
    )
    sets = paths.groupBy("change_set_id").agg(
        F.count("path").alias("n_interfaces"), F.sum("n").alias("n_changes")
    )
    raised = F.array_compact(F.array(
        F.when(F.col("n_interfaces") > 1, F.struct(F.col("n_interfaces").alias("n"), _risk("R15").alias("risk"))),
        F.when(F.col("n_changes") > LARGE_CHANGE_SET, F.struct(F.col("n_changes").alias("n"), _risk("R16").alias("risk"))),
    ))
    return sets.select("change_set_id", F.inline(raised)).select(
        "change_set_id", F.lit(None).cast("long").alias("ordinal"), "risk.*",
        F.lit(None).cast("string").alias("component"), F.col("n").alias("n_components"),
    )


def first_changed_files(changes: DataFrame, limit: int = 5) -> DataFrame:
    """First paths of every large change set, followed by ``...``."""
    order = Window.partitionBy("change_set_id").orderBy("ordinal")
    first = (
        changes.select("change_set_id", "ordinal", "file_path")
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= max(limit, LARGE_CHANGE_SET + 1))
    )
    grouped = first.groupBy("change_set_id").agg(
        F.count("*").alias("n"),
        F.sort_array(
            F.collect_list(F.when(F.col("position") <= limit, F.struct("position", "file_path")))
        ).alias("head"),
    )
    shown = F.concat(F.transform("head", lambda h: h["file_path"]), F.array(F.lit("...")))
    return grouped.filter(F.col("n") > LARGE_CHANGE_SET).select("change_set_id", shown.alias("affected_components"))


def all_risks(changes: DataFrame) -> DataFrame:
    return change_risks(changes).withColumn("n_components", F.lit(1).cast("long")).unionByName(
        change_set_risks(changes)
    )


def distinct_risks(risks: DataFrame) -> DataFrame:
    """First risk per (type, description, component) of a change set.

    Set-level risks, whose ``ordinal`` is null, come after those of single changes. The first emission
    decides the severity, which is not part of the key.
    """
    emitted = F.struct(
        F.col("ordinal").isNull().alias("of_set"), "ordinal", "stage", "sub_ordinal", "rule_id", "severity",
        "subject", "n_components",
    )
    first = risks.groupBy("change_set_id", "type", "description", "component").agg(F.min(emitted).alias("first"))
    return first.select("change_set_id", "type", "description", "component", "first.*").drop("of_set")


def priority(severity: Column | str = "severity", risk_type: Column | str = "type") -> Column:
    def score(column: Column, scores: dict[str, int]) -> Column:
        graded = F.lit(0)
        for value, points in scores.items():
            graded = F.when(column == value, points).otherwise(graded)
        return graded

    severity = F.col(severity) if isinstance(severity, str) else severity
    risk_type = F.col(risk_type) if isinstance(risk_type, str) else risk_type
    return score(severity, SEVERITY_SCORES) * 10 + score(risk_type, RISK_TYPE_SCORES)


def risk_order() -> list[Column]:
    return [F.asc_nulls_last("ordinal"), F.asc("stage"), F.asc("sub_ordinal")]


def prioritized(risks: DataFrame) -> DataFrame:
    """Most urgent first within each change set; a range sort, so a large set is split."""
    scored = risks.withColumn("priority", priority())
    return scored.orderBy("change_set_id", F.desc("priority"), *risk_order())


def regression_risks(changes: DataFrame) -> DataFrame:
    """The full scan: rules, deduplication, priority order."""
    return prioritized(distinct_risks(all_risks(changes)))


def _by_rule(value) -> Column:
    pairs = [part for rule in RISK_RULES for part in (F.lit(rule.rule_id), value(rule))]
    return F.element_at(F.create_map(*pairs), F.col("rule_id"))


def with_guidance(risks: DataFrame) -> DataFrame:
    """Adds ``mitigation`` and ``test_suggestions``, which follow from the rule."""
    suggestions = F.transform(
        _by_rule(lambda rule: F.array(*[F.lit(t) for t in rule.tests])),
        lambda t: F.replace(t, F.lit("{}"), F.coalesce("subject", F.lit(""))),
    )
    return risks.withColumn("mitigation", _by_rule(lambda rule: F.lit(rule.mitigation))).withColumn(
        "test_suggestions", suggestions
    )


def first_risks(risks: DataFrame, keys: list[str], limit: int, before: tuple[str, ...] = ()) -> DataFrame:
    """First ``limit`` risks per key with their ``position``: by ``before``, then most urgent first."""
    order = Window.partitionBy(*keys).orderBy(*before, F.desc(priority()), *risk_order())
    return risks.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def severe() -> Column:
    return F.col("severity").isin("critical", "high")


def breaking() -> Column:
    return (F.col("type") == "api_change") & severe()
