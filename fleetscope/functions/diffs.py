"""Unified-diff expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


def marked_lines(diff_lines: Column, mark: str) -> Column:
    """Lines carrying ``mark``, stripped of it; the ``---``/``+++`` headers are not lines."""
    kept = F.filter(diff_lines, lambda l: l.startswith(mark) & ~l.startswith(mark * 3))
    return F.transform(kept, lambda l: F.substring(l, 2, 2147483647))


def count_lines_with(lines: Column, needles: list[str]) -> Column:
    return F.size(F.filter(lines, lambda l: text.contains_any(l, needles)))


def signatures(lines: Column, side: int) -> Column:
    """``array<struct<name, side, pos, params>>`` of the first ``def`` on each line."""
    define = text.pattern(r"def\s+(\w+)\s*\(([^)]*)\)")
    numbered = F.transform(lines, lambda l, i: F.struct(l.alias("line"), i.alias("pos")))
    defs = F.filter(numbered, lambda n: n["line"].rlike(define))

    def signature(n: Column) -> Column:
        raw = F.split(F.regexp_extract(n["line"], define, 2), ",")
        params = F.filter(F.transform(raw, text.strip), lambda p: p != "")
        return F.struct(
            F.regexp_extract(n["line"], define, 1).alias("name"),
            F.lit(side).alias("side"),
            n["pos"].alias("pos"),
            params.alias("params"),
        )

    return F.transform(defs, signature)


def ordered_definitions(removed: Column, added: Column) -> Column:
    """All definitions sorted by (name, side, line)."""
    return F.sort_array(F.concat(signatures(removed, 0), signatures(added, 1)))


def last_definitions(ordered: Column) -> Column:
    """Last definition per (name, side) of an :func:`ordered_definitions` column.

    Sorting brings the definitions of a name together, so one pass over
    neighbours is enough: no nested scan, and no shuffle.
    """
    return F.filter(
        ordered,
        lambda d, i: F.get(ordered, i + 1).isNull()
        | (F.get(ordered, i + 1)["name"] != d["name"])
        | (F.get(ordered, i + 1)["side"] != d["side"]),
    )


def parameter_changes(definitions: Column) -> Column:
    """Functions defined on both sides with other parameters, in name order.

    ``definitions`` is a :func:`last_definitions` column.
    """
    added = F.filter(
        F.transform(
            definitions,
            lambda d, i: F.struct(
                d["name"].alias("name"),
                d["side"].alias("side"),
                F.when(F.get(definitions, i - 1)["name"] == d["name"], F.get(definitions, i - 1)["params"]).alias("old"),
                d["params"].alias("new"),
            ),
        ),
        lambda d: (d["side"] == 1) & d["old"].isNotNull() & (d["old"] != d["new"]),
    )
    return F.transform(
        added,
        lambda d: F.struct(
            d["name"].alias("function"),
            F.sort_array(F.array_except(d["old"], d["new"])).alias("removed_params"),
            F.sort_array(F.array_except(d["new"], d["old"])).alias("added_params"),
        ),
    )
