"""Ordered row labelling: the first rule that holds gives the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Causes in the order in which they win, and the marker for "no value".
DELAY_CAUSES = ("WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay")
NO_VALUE = "NA"
UNCATEGORIZED = "UncategorizedDelay"


def first_match(rules: Sequence[tuple[Column, Column | str]]) -> Column:
    """Label of the first rule whose condition is true; a null condition does not count.

    Null where no rule holds. One CASE expression, so it stays inside code generation.
    """
    if not rules:
        raise ValueError("first_match needs at least one rule")
    chain = F
    for condition, label in rules:
        chain = chain.when(condition, label if isinstance(label, Column) else F.lit(label))
    return chain


def delay_type(df: DataFrame) -> DataFrame:
    """Add ``delay_type``: the first named cause, else uncategorized if delayed at all."""
    causes = [(F.col(cause) != NO_VALUE, cause) for cause in DELAY_CAUSES]
    delayed = (F.col("IsArrDelayed") == "YES") | (F.col("IsDepDelayed") == "YES")
    return df.withColumn("delay_type", first_match([*causes, (delayed, UNCATEGORIZED)]))
