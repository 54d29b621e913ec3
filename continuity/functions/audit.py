"""Columns that say when a row was loaded and from which file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_columns(df: DataFrame, include_time: bool = True) -> DataFrame:
    """Add ``last_updated_time`` (or ``last_updated_date``) and ``source_file``.

    ``df`` must come from files and must not have passed an aggregate or a shuffle join:
    the file name is the scan's hidden ``_metadata`` column. Works for batch and stream.
    """
    if include_time:
        stamped = df.withColumn("last_updated_time", F.current_timestamp())
    else:
        stamped = df.withColumn("last_updated_date", F.current_date())
    return stamped.withColumn("source_file", F.col("_metadata.file_path"))
