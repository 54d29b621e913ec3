"""External volumes: create what is missing, follow the owner of what exists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuity.functions.names import qualified_name
from continuity.operators.listing import external_volumes

KEYS = ["catalog", "schema", "name"]
CREATED = "success"
EXISTED = "already_exists"


def _problem(rows: DataFrame, schemas: DataFrame | None) -> DataFrame:
    """Add ``error``: why a volume cannot be made, null where it can."""
    unplaced = F.when(F.col("storage_location").isNull(), "no storage location")
    if schemas is None:
        return rows.withColumn("error", unplaced)
    there = schemas.select("catalog", "schema", F.lit(True).alias("there")).distinct()
    name = F.concat_ws(".", "catalog", "schema")
    absent = F.when(F.col("there").isNull(), F.concat(F.lit("no schema "), name))
    return (
        rows.join(there, ["catalog", "schema"], "left")
        .withColumn("error", F.coalesce(unplaced, absent))
        .drop("there")
    )


def volume_upsert(
    source: DataFrame, target: DataFrame, schemas: DataFrame | None = None
) -> DataFrame:
    """One row per external source volume: what was done to the target.

    A new volume without a location, or (with ``schemas`` of the target) without its schema,
    cannot be made and has the status ``ERROR: <why>``.
    """
    wanted = external_volumes(source)
    known = target.select(*KEYS, F.col("owner").alias("target_owner"), F.lit(True).alias("known"))
    existed = F.col("known").isNotNull()
    return _problem(wanted.join(known, KEYS, "left"), schemas).select(
        *KEYS,
        qualified_name(*KEYS).alias("full_name"),
        "storage_location",
        "owner",
        F.when(existed, EXISTED)
        .when(F.col("error").isNotNull(), F.concat(F.lit("ERROR: "), "error"))
        .otherwise(CREATED)
        .alias("status"),
        (existed & ~F.col("owner").eqNullSafe(F.col("target_owner"))).alias("owner_changed"),
    )


def registry_after(
    source: DataFrame, target: DataFrame, schemas: DataFrame | None = None
) -> DataFrame:
    """The target's volumes after the upsert. Location and type of known ones stay; volumes
    that cannot be made are left out."""
    wanted = _problem(external_volumes(source), schemas)
    new = wanted.withColumn("makeable", F.col("error").isNull()).select(
        *KEYS,
        F.col("volume_type").alias("new_type"),
        F.col("storage_location").alias("new_location"),
        F.col("owner").alias("new_owner"),
        F.lit(True).alias("wanted"),
        "makeable",
    )
    old = target.select(*KEYS, "volume_type", "storage_location", "owner", F.lit(True).alias("known"))
    known, wanted = F.col("known").isNotNull(), F.col("wanted").isNotNull()
    both = old.join(new, KEYS, "full_outer").filter(known | F.col("makeable"))
    return both.select(
        *KEYS,
        F.when(known, F.col("volume_type")).otherwise(F.col("new_type")).alias("volume_type"),
        F.when(known, F.col("storage_location"))
        .otherwise(F.col("new_location"))
        .alias("storage_location"),
        F.when(wanted, F.col("new_owner")).otherwise(F.col("owner")).alias("owner"),
    )
