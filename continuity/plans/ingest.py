"""The example ingest: flight files in, labelled and audited rows appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from continuity.functions import audit_columns, delay_type
from continuity.operators.sampling import first_rows
from continuity.sinks import append
from continuity.sources import read_batch, read_stream


def labelled(files: DataFrame, include_time: bool = True) -> DataFrame:
    """The transforms shared by batch and stream."""
    return files.transform(delay_type).transform(audit_columns, include_time)


def ingest_flights(
    spark: SparkSession,
    path: str,
    table: str,
    limit: int | None = None,
    include_time: bool = True,
    fmt: str = "parquet",
) -> DataFrame:
    """Append the files below ``path`` to ``table`` and return the table.

    ``limit`` takes that many rows, any ones, for a trial run.
    """
    files = read_batch(spark, path)
    if limit is not None:
        files = first_rows(files, limit)
    append(labelled(files, include_time), table, fmt=fmt)
    return spark.table(table)


def ingest_flights_stream(
    spark: SparkSession,
    path: str,
    table: str,
    checkpoint_location: str,
    include_time: bool = True,
    fmt: str = "parquet",
    max_bytes_per_trigger: int | None = None,
) -> StreamingQuery:
    """The same for files as they arrive; each file is taken once per checkpoint."""
    files = read_stream(spark, path, max_bytes_per_trigger=max_bytes_per_trigger)
    return append(labelled(files, include_time), table, True, checkpoint_location, fmt)
