"""Positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_positions(df: DataFrame, key: str, ordinal: str, chunk: int = 65536) -> DataFrame:
    """Adds ``position`` (1, 2, ... by ``ordinal``) and ``total`` per ``key``.

    Ordinals are cut into chunks. Rows are numbered within (key, chunk); the rows
    before a chunk come from a table of chunk sizes. So no task holds more than a
    chunk of rows of one key, and the table of sizes is ``chunk`` times smaller.
    """
    chunked = df.withColumn("chunk", F.floor(F.col(ordinal) / chunk))
    sizes = chunked.groupBy(key, "chunk").agg(F.count("*").alias("rows"))
    by_chunk = Window.partitionBy(key).orderBy("chunk")
    before = F.coalesce(F.sum("rows").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(
        key, "chunk", before.alias("before"), F.sum("rows").over(Window.partitionBy(key)).alias("total")
    )
    within = F.row_number().over(Window.partitionBy(key, "chunk").orderBy(ordinal))
    numbered = chunked.withColumn("within", within).join(offsets, [key, "chunk"])
    return numbered.withColumn("position", F.col("before") + F.col("within")).drop("chunk", "within", "before")
