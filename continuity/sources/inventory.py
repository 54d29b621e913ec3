"""Inventories: what catalogs, schemas, tables, volumes, locations and grants one side has.

An inventory is a set of DataFrames. It is read from exported files, or listed from the
session catalog.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from continuity import schemas as S
from continuity.functions.names import quote
from continuity.threads import run_each
from continuity.workspace import run_folder

_DDL = {
    "catalogs": S.CATALOGS_DDL,
    "schemas": S.SCHEMAS_DDL,
    "tables": S.TABLES_DDL,
    "volumes": S.VOLUMES_DDL,
    "locations": S.LOCATIONS_DDL,
    "grants": S.GRANTS_DDL,
}


@dataclass(frozen=True)
class Inventory:
    """One side of a sync. A part that is None was not listed: it counts as empty where that
    changes nothing on the target, and steps that would undo things for it are skipped."""

    catalogs: DataFrame | None = None
    schemas: DataFrame | None = None
    tables: DataFrame | None = None
    volumes: DataFrame | None = None
    locations: DataFrame | None = None
    grants: DataFrame | None = None

    def complete(self, spark: SparkSession) -> Inventory:
        missing = {
            part: spark.createDataFrame([], ddl)
            for part, ddl in _DDL.items()
            if getattr(self, part) is None
        }
        return replace(self, **missing)


def read_inventory(spark: SparkSession, folder: str, fmt: str = "parquet") -> Inventory:
    """Read an exported inventory: one sub-folder per part, under the declared schemas.

    Parts without a folder were not exported and stay None; a folder without any part is no
    inventory and raises.
    """
    parts = {}
    for part, ddl in _DDL.items():
        try:
            parts[part] = spark.read.schema(ddl).format(fmt).load(f"{folder}/{part}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    if not parts:
        raise ValueError(f"no inventory in {folder}: none of {', '.join(_DDL)} is there")
    return Inventory(**parts)


def describe_table(spark: SparkSession, identifier: str) -> dict:
    """Catalog facts of one table or view, as Spark's own JSON description."""
    row = spark.sql(f"DESCRIBE TABLE EXTENDED {identifier} AS JSON").first()
    return json.loads(row[0])


def _properties(text: str | None) -> dict[str, str] | None:
    """The properties of a database, from the form ``((a,b), (c,d))`` of its description."""
    if not text:
        return None
    pairs = text.strip()[1:-1].strip("()").split("), (")
    return dict(pair.split(",", 1) for pair in pairs if "," in pair) or None


def _listed_tables(
    spark: SparkSession, catalog: str, databases: Iterable[str], workers: int
) -> Iterator[tuple[str | None, ...]]:
    def names() -> Iterator[tuple[str, str]]:
        for database in databases:
            for listed in spark.sql(f"SHOW TABLES IN {quote(database)}").toLocalIterator():
                if not listed.isTemporary:
                    yield database, listed.tableName

    def facts(name: tuple[str, str]) -> tuple[str | None, ...]:
        found = describe_table(spark, quote(*name))
        return (
            catalog,
            *name,
            found["type"],
            found.get("provider"),
            found.get("location"),
            found.get("view_original_text") or found.get("view_text"),
            found.get("owner"),
        )

    return run_each(facts, names(), workers)


def write_rows(
    spark: SparkSession, rows: Iterable[tuple], ddl: str, folder: str, batch: int
) -> DataFrame:
    """Rows that the driver makes, ``batch`` of them in its memory at a time."""
    source = iter(rows)
    spark.createDataFrame([], ddl).write.mode("append").parquet(folder)
    while chunk := list(islice(source, batch)):
        spark.createDataFrame(chunk, ddl).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(ddl).parquet(folder)


def live_inventory(
    spark: SparkSession,
    databases: Iterable[str],
    catalog: str = "spark_catalog",
    batch: int = 1000,
    workers: int = 8,
) -> Inventory:
    """List the session catalog. The catalog answers on the driver only, ``workers`` tables at a
    time; the listing is written to the shared folder every ``batch`` rows and read back as a
    DataFrame. ``sources.pages`` reads exported listings without asking the catalog."""
    folder = run_folder(spark, "inventory")
    databases = list(databases)
    described = []
    for database in databases:
        facts = {
            row.info_name: row.info_value
            for row in spark.sql(f"DESCRIBE DATABASE EXTENDED {quote(database)}").collect()
        }
        described.append(
            (catalog, database, facts.get("Comment") or None, _properties(facts.get("Properties")))
        )
    tables = _listed_tables(spark, catalog, databases, workers)
    return Inventory(
        catalogs=spark.createDataFrame([(catalog, "MANAGED_CATALOG")], S.CATALOGS_DDL),
        schemas=write_rows(spark, described, S.SCHEMAS_DDL, f"{folder}/schemas", batch),
        tables=write_rows(spark, tables, S.TABLES_DDL, f"{folder}/tables", batch),
    )
