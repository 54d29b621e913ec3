"""Append to a named table, from a batch or from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from continuity.streaming.ingest import append_stream


def append(
    df: DataFrame,
    table: str,
    streaming: bool = False,
    checkpoint_location: str | None = None,
    fmt: str = "parquet",
    partition_by: tuple[str, ...] = (),
) -> StreamingQuery | None:
    """Append ``df`` to ``table``, creating it when absent.

    Columns are matched by name; a different set of columns or another format is refused.
    A batch append is not idempotent (a rerun adds the rows again). A stream is: its
    checkpoint remembers the files taken. The stream's query is returned.
    """
    if streaming:
        return append_stream(df, table, checkpoint_location, fmt=fmt, partition_by=partition_by)
    writer = df.write.format(fmt).mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)
    return None
