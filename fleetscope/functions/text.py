"""Text and path expressions with the meaning the Python rules have.

The rules are written as Python ``re`` patterns. Spark evaluates Java patterns,
whose ``\\w``, ``\\s``, ``.`` and case folding differ, so :func:`pattern` spells
those out. Everything here is a built-in column expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters for which Python's str.isspace() holds, newline kept apart.
_BLANK = r"\t\x0b-\r\x1c- \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"[\p{L}\p{N}_]"


def pattern(python_pattern: str, ignore_case: bool = False, one_line: bool = False) -> str:
    """Java form of a Python pattern.

    ``one_line`` keeps every match inside one line, so that a text of joined
    lines can be searched at once instead of line by line.
    """
    space = f"[{_BLANK}]" if one_line else f"[\\n{_BLANK}]"
    java = python_pattern.replace(r"\s", space).replace(r"\w", _WORD)
    if one_line:
        java = java.replace("[^", r"[^\n")
    return ("(?diu)" if ignore_case else "(?d)") + java


def strip(text: Column) -> Column:
    space = f"[\\n{_BLANK}]"
    return F.regexp_replace(text, f"^{space}+|{space}+$", "")


def words(text: Column) -> Column:
    """Blank-separated words; no empty ones."""
    return F.filter(F.split(text, f"[\\n{_BLANK}]+"), lambda w: w != "")


def unix_newlines(text: Column) -> Column:
    """Line ends as text-mode reading gives them; works on bytes, so bad UTF-8 stays visible."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def contains_any(text: Column, needles: list[str]) -> Column:
    """Plain, case-sensitive substring tests joined by OR."""
    found = F.contains(text, F.lit(needles[0]))
    for needle in needles[1:]:
        found = found | F.contains(text, F.lit(needle))
    return found


def path_segments(path: Column) -> Column:
    """Segments of a relative or absolute path; ``.`` and empty ones dropped."""
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def fixed(value: Column, digits: int) -> Column:
    """``f'{value:.<digits>f}'``: half-even on the exact binary value, no grouping."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))
