"""Array columns to rows.

A plain ``inline``/``explode`` makes the optimizer add a "not empty" filter and
push it below the projection that computes the array, so the array would be
computed twice. The outer form followed by a null filter computes it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inline_rows(df: DataFrame, keys: list[Column | str], structs: Column | str, required: str) -> DataFrame:
    """``keys`` and the fields of each struct; ``required`` is a field never null in one."""
    return df.select(*keys, F.inline_outer(structs)).filter(F.col(required).isNotNull())


def explode_rows(df: DataFrame, keys: list[Column | str], values: Column | str, name: str) -> DataFrame:
    """``keys`` and each non-null value as ``name``."""
    return df.select(*keys, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())
