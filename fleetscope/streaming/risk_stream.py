"""Per-change risk rules over a stream of changes.

The rules look at one change at a time and keep no state, so a streaming table
goes through the same expressions as a batch one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.risks import change_risks, priority


def stream_risks(changes: DataFrame) -> DataFrame:
    return change_risks(changes).withColumn("priority", priority())


def write_risk_stream(changes: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends the risks of arriving changes to a table."""
    writer = stream_risks(changes).writeStream.outputMode("append").format("parquet")
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
