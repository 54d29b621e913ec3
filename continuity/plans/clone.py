"""Clone plans: one row per table to copy, worked out in Spark before any copy starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuity.functions.names import qualified_name
from continuity.operators.locations import remap_locations

BY_NAME, BY_PATH = "name", "path"


def _plan(
    tables: DataFrame,
    kind: str,
    source: Column,
    source_location: Column,
    target_location: Column,
    problem: Column,
) -> DataFrame:
    return tables.select(
        "catalog",
        "schema",
        F.col("name").alias("table"),
        F.lit(kind).alias("kind"),
        source.alias("source"),
        qualified_name("catalog", "schema", "name").alias("target"),
        "format",
        source_location.alias("source_location"),
        target_location.alias("target_location"),
        problem.alias("problem"),
    )


def clone_by_name(tables: DataFrame, source_suffix: str = "_share") -> DataFrame:
    """Copy through the catalog under which the source is shared (``<catalog>_share``)."""
    shared = F.concat(F.col("catalog"), F.lit(source_suffix))
    nothing = F.lit(None).cast("string")
    return _plan(
        tables, BY_NAME, qualified_name(shared, "schema", "name"), nothing, nothing, nothing
    )


def clone_by_path(
    tables: DataFrame, source_locations: DataFrame, target_locations: DataFrame
) -> DataFrame:
    """Copy from the storage path to the path moved to the target's locations.

    A path without a location on either side keeps its row, with ``problem`` filled.
    """
    moved = remap_locations(tables, source_locations, target_locations)
    by_path = F.concat(F.col("format"), F.lit(".`"), F.col("storage_location"), F.lit("`"))
    return _plan(
        moved,
        BY_PATH,
        by_path,
        F.col("storage_location"),
        F.col("target_location"),
        F.col("problem"),
    )


def duplicate_targets(plan: DataFrame) -> DataFrame:
    """Targets that more than one row of the plan would write: an error in the plan."""
    return plan.groupBy("target").agg(F.count(F.lit(1)).alias("writers")).filter("writers > 1")
