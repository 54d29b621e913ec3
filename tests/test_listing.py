from __future__ import annotations

import pytest

from continuity.operators import listing as L
from continuity.operators.volumes import registry_after, volume_upsert
from continuity.plans.clone import clone_by_name, clone_by_path, duplicate_targets
from continuity.schemas import SCHEMAS_DDL, TABLES_DDL, VOLUMES_DDL
from continuity.sources import Inventory, live_inventory, read_inventory
from continuity.workspace import run_database
from tests.helpers import rows


@pytest.fixture(scope="module")
def tables(spark):
    def table(catalog, schema, name, kind, fmt="parquet", path=None, view=None):
        return (catalog, schema, name, kind, fmt, path, view, "me")

    return spark.createDataFrame(
        [
            table("main", "s", "m", "MANAGED"),
            table("main", "s", "e", "EXTERNAL", path="src://a/e"),
            table("main", "s", "d", "EXTERNAL", "delta", "src://zzz/d"),
            table("main", "s", "v", "VIEW", view="SELECT 1"),
            table("main", "information_schema", "tables", "EXTERNAL"),
            table("share", "s", "e", "EXTERNAL", path="src://a/f"),
        ],
        TABLES_DDL,
    )


@pytest.fixture(scope="module")
def catalogs(spark):
    return spark.createDataFrame(
        [("main", "MANAGED_CATALOG"), ("share", "DELTASHARING_CATALOG")],
        "catalog string, catalog_type string",
    )


def names(df):
    return sorted((r.catalog, r.name) for r in df.collect())


def test_filters(tables, catalogs):
    assert len(names(L.user_tables(tables))) == 5
    assert names(L.user_tables(tables, "VIEW")) == [("main", "v")]
    assert names(L.copy_candidates(tables, catalogs, ["EXTERNAL"])) == [("main", "d"), ("main", "e")]
    assert names(L.copy_candidates(tables, catalogs, ["EXTERNAL"], formats=["delta"])) == [("main", "d")]
    assert names(L.copy_candidates(tables, catalogs, ["EXTERNAL"], catalog_types=())) == [
        ("main", "d"), ("main", "e"), ("share", "e"),
    ]
    assert names(L.copy_candidates(tables, catalogs, [])) == []
    assert rows(L.schemas_of(L.user_tables(tables))) == {("main", "s"): 1, ("share", "s"): 1}


def test_enumeration_by_schema(spark, tables):
    listed = spark.createDataFrame([("share", "s"), ("main", "other")], "catalog string, schema string")
    assert names(L.in_schemas(tables, listed)) == [("share", "e")]


def test_schema_difference(spark):
    source = spark.createDataFrame(
        [("c", "a", "text", {"k": "v"}), ("c", "b", None, None), ("d", "b", None, None)], SCHEMAS_DDL
    )
    target = spark.createDataFrame([("c", "b", None, None), ("c", "z", None, None)], SCHEMAS_DDL)
    missing = {(r.catalog, r.schema): (r.comment, r.properties) for r in L.missing_schemas(source, target).collect()}
    assert missing == {("c", "a"): ("text", {"k": "v"}), ("d", "b"): (None, None)}
    orphans = L.only_in_target(source, target, ["catalog", "schema"])
    assert [(r.catalog, r.schema) for r in orphans.collect()] == [("c", "z")]


def test_clone_plans(spark, tables, catalogs):
    places = spark.createDataFrame([("a", "src://a")], "name string, url string")
    moved = spark.createDataFrame([("a", "dst://b")], "name string, url string")
    named = clone_by_name(L.copy_candidates(tables, catalogs, ["MANAGED"]))
    assert [(r.source, r.target, r.kind) for r in named.collect()] == [("main_share.s.m", "main.s.m", "name")]
    by_path = clone_by_path(L.copy_candidates(tables, catalogs, ["EXTERNAL"]), places, moved)
    got = {r.table: (r.source, r.target_location, r.problem) for r in by_path.collect()}
    assert got == {
        "e": ("parquet.`src://a/e`", "dst://b/e", None),
        "d": ("delta.`src://zzz/d`", None, "no location"),
    }
    both = named.unionByName(by_path)
    assert duplicate_targets(both).count() == 0
    assert [r.target for r in duplicate_targets(both.unionByName(named)).collect()] == ["main.s.m"]


def test_volumes(spark):
    source = spark.createDataFrame(
        [
            ("c", "s", "new", "EXTERNAL", "p://1", "ann"),
            ("c", "s", "known", "EXTERNAL", "p://2", "ann"),
            ("c", "s", "same", "EXTERNAL", "p://3", "bob"),
            ("c", "s", "inner", "MANAGED", "p://4", "ann"),
        ],
        VOLUMES_DDL,
    )
    target = spark.createDataFrame(
        [
            ("c", "s", "known", "EXTERNAL", "q://2", "old"),
            ("c", "s", "same", "EXTERNAL", "p://3", "bob"),
            ("c", "s", "extra", "EXTERNAL", "p://9", "eve"),
            ("c", "s", "inner", "MANAGED", "q://4", "zoe"),
        ],
        VOLUMES_DDL,
    )
    done = {r.name: (r.status, r.owner_changed) for r in volume_upsert(source, target).collect()}
    assert done == {
        "new": ("success", False),
        "known": ("already_exists", True),
        "same": ("already_exists", False),
    }
    after = registry_after(source, target)
    held = {r.name: (r.storage_location, r.owner) for r in after.collect()}
    assert held == {
        "new": ("p://1", "ann"),
        "known": ("q://2", "ann"),
        "same": ("p://3", "bob"),
        "extra": ("p://9", "eve"),
        "inner": ("q://4", "zoe"),
    }
    assert rows(registry_after(source, after.select(*target.columns))) == rows(after)


def test_live_and_exported_inventory(spark, tmp_path):
    database = run_database(spark, "live")
    spark.range(3).write.option("path", str(tmp_path / "e")).saveAsTable(f"{database}.e")
    spark.range(3).write.saveAsTable(f"{database}.m")
    spark.sql(f"CREATE VIEW {database}.v AS SELECT id FROM {database}.e")
    live = live_inventory(spark, [database], batch=2)
    got = {r.name: r for r in live.tables.collect()}
    assert {n: r.table_type for n, r in got.items()} == {"e": "EXTERNAL", "m": "MANAGED", "v": "VIEW"}
    assert got["e"].storage_location.endswith("/e") and got["e"].format == "parquet"
    assert got["v"].view_definition == f"SELECT id FROM {database}.e"
    assert [r.schema for r in live.schemas.collect()] == [database]
    live.tables.write.parquet(str(tmp_path / "x" / "tables"))
    exported = read_inventory(spark, str(tmp_path / "x"))
    assert rows(exported.tables) == rows(live.tables)
    assert exported.grants is None and isinstance(exported, Inventory)
    assert exported.complete(spark).grants.count() == 0


def test_filters_reach_the_scan(spark, tables, tmp_path):
    tables.write.parquet(str(tmp_path / "tables"))
    listed = read_inventory(spark, str(tmp_path)).tables
    chosen = L.user_tables(listed, "VIEW").select("name", "view_definition")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        text = chosen._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(table_type,VIEW)" in text
    assert "Not(EqualTo(schema,information_schema))" in text
    scanned = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in scanned.split(",")} == {
        "schema", "name", "table_type", "view_definition",
    }
