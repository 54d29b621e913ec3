"""Append-only, stateless streams into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_stream(
    df: DataFrame,
    table: str,
    checkpoint_location: str | None,
    fmt: str = "parquet",
    available_now: bool = True,
    partition_by: tuple[str, ...] = (),
) -> StreamingQuery:
    """Start appending ``df`` to ``table`` and return the running query.

    ``available_now`` takes what is there and stops; otherwise the stream keeps running. The
    checkpoint is required: it is what makes a restart pick up where the last run ended.
    """
    if not checkpoint_location:
        raise ValueError("a streaming append needs a checkpoint_location")
    writer = (
        df.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint_location)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.toTable(table)
