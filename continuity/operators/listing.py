"""Select objects from an inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuity.functions.names import qualified_name
from continuity.operators.joins import keyed_join

# Fixed value: the schema every catalog has by itself.
SYSTEM_SCHEMA = "information_schema"


def user_tables(tables: DataFrame, *table_types: str) -> DataFrame:
    """Tables outside the system schema, of the given types (all types when none is given)."""
    kept = tables.filter(F.col("schema") != SYSTEM_SCHEMA)
    if table_types:
        kept = kept.filter(F.col("table_type").isin(*table_types))
    return kept


def external_volumes(volumes: DataFrame) -> DataFrame:
    return volumes.filter(F.col("volume_type") == "EXTERNAL")


def in_schemas(objects: DataFrame, schemas: DataFrame) -> DataFrame:
    """Objects of the listed schemas: the schema-by-schema enumeration as one semi join."""
    listed = schemas.select("catalog", "schema")
    return keyed_join(objects, listed, ["catalog", "schema"], "left_semi", spread_by=["name"])


def in_catalogs(objects: DataFrame, catalogs: DataFrame, *catalog_types: str) -> DataFrame:
    """Objects of catalogs of the given types (of all listed catalogs when none is given)."""
    kept = catalogs
    if catalog_types:
        kept = kept.filter(F.col("catalog_type").isin(*catalog_types))
    spread = [c for c in ("schema", "name") if c in objects.columns]
    return keyed_join(objects, kept.select("catalog"), ["catalog"], "left_semi", spread_by=spread)


def copy_candidates(
    tables: DataFrame,
    catalogs: DataFrame,
    table_types: Sequence[str],
    catalog_types: Sequence[str] = ("MANAGED_CATALOG",),
    formats: Sequence[str] | None = None,
) -> DataFrame:
    """Tables to copy: by type, by kind of catalog and, if asked for, by file format."""
    kept = user_tables(tables).filter(F.col("table_type").isin(list(table_types)))
    if formats is not None:
        kept = kept.filter(F.col("format").isin(*formats))
    return in_catalogs(kept, catalogs, *catalog_types)


def schemas_of(objects: DataFrame) -> DataFrame:
    """Distinct schemas of the selected objects: what has to be shared with the replica."""
    return objects.select("catalog", "schema").distinct()


def missing_schemas(source: DataFrame, target: DataFrame) -> DataFrame:
    """Full rows of the schemas the source has and the target lacks."""
    return source.join(target.select("catalog", "schema"), ["catalog", "schema"], "left_anti")


def only_in_target(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Report of target objects without a source object. They are never dropped."""
    return target.join(source.select(*keys), list(keys), "left_anti")


def securables(
    catalogs: DataFrame | None = None,
    schemas: DataFrame | None = None,
    tables: DataFrame | None = None,
    volumes: DataFrame | None = None,
) -> DataFrame:
    """One row per object that can hold grants, in the order catalog, schema, table, volume."""
    no_schema = F.lit(None).cast("string").alias("schema")
    parts = []
    if catalogs is not None:
        parts.append(
            catalogs.select(
                F.lit("CATALOG").alias("securable_type"),
                F.col("catalog").alias("full_name"),
                "catalog",
                no_schema,
            )
        )
    if schemas is not None:
        parts.append(
            schemas.select(
                F.lit("SCHEMA").alias("securable_type"),
                qualified_name("catalog", "schema").alias("full_name"),
                "catalog",
                "schema",
            )
        )
    for kind, objects in (("TABLE", tables), ("VOLUME", volumes)):
        if objects is not None:
            kept = user_tables(objects) if kind == "TABLE" else objects
            parts.append(
                kept.select(
                    F.lit(kind).alias("securable_type"),
                    qualified_name("catalog", "schema", "name").alias("full_name"),
                    "catalog",
                    "schema",
                )
            )
    if not parts:
        raise ValueError("securables needs at least one listing")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
