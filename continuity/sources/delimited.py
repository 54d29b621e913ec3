"""Delimited files under a declared schema, as a batch or as a stream.

The schema is always given, so no pass is spent on inference. Malformed cells follow
Spark's PERMISSIVE mode: an unparsable int is null, a short line has trailing nulls, surplus
fields are dropped, an empty field is null, and without ``header`` a header line is a data row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from continuity.schemas import flight_schema


def read_batch(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    header: bool = False,
    **options: str,
) -> DataFrame:
    reader = spark.read.format("csv").option("header", str(header).lower()).options(**options)
    return reader.schema(schema if schema is not None else flight_schema()).load(path)


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    header: bool = False,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Files as they arrive, those already there included.

    Which files were taken is kept in the writer's checkpoint. A backlog is cut into
    micro-batches by either limit; with an ``availableNow`` writer every file is still read.
    """
    reader = spark.readStream.format("csv").option("header", str(header).lower())
    if max_files_per_trigger is not None and max_bytes_per_trigger is not None:
        raise ValueError("give max_files_per_trigger or max_bytes_per_trigger, not both")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    declared = schema if schema is not None else flight_schema()
    return reader.options(**options).schema(declared).load(path)
