from __future__ import annotations

import pytest

from continuity.operators.joins import JoinLimits
from continuity.operators.locations import location_pairs, remap_locations
from tests.helpers import plan

FEW = JoinLimits()
MANY = JoinLimits(broadcast_rows=0, broadcast_bytes=0, hot_rows=3, hot_share=10)

SOURCE = [
    ("a", "src://r0"),
    ("deep", "src://r0/deep"),
    ("slash", "src://r1/"),
    ("lost", "src://r2"),
    ("twin_b", "src://r3"),
    ("twin_a", "src://r3"),
    ("local", "file:/mnt/data"),
    ("nowhere", "src://"),
    ("account", "abfss://c@acct.example/base"),
]
TARGET = [
    ("a", "dst://t0"),
    ("deep", "dst://t9/x/"),
    ("slash", "dst://t1"),
    ("twin_a", "dst://ta"),
    ("twin_b", "dst://tb"),
    ("local", "file:/mnt/copy"),
    ("nowhere", "dst://"),
    ("account", "abfss://c@other.example/base"),
    ("unused", "dst://unused"),
]
CASES = {
    "src://r0/1": ("a", "dst://t0/1", None),
    "src://r0": ("a", "dst://t0", None),
    "src://r0b/1": (None, None, "no location"),
    "src://r0/deep/1": ("deep", "dst://t9/x/1", None),
    "src://r0/deep": ("deep", "dst://t9/x", None),
    "src://r0/deeper/1": ("a", "dst://t0/deeper/1", None),
    # The url again inside the path stays.
    "src://r0/src://r0/2": ("a", "dst://t0/src://r0/2", None),
    "src://r1/1": ("slash", "dst://t1/1", None),
    "src://r2/1": ("lost", None, "no target location"),
    "src://r3/1": ("twin_a", "dst://ta/1", None),
    "file:/mnt/data/t": ("local", "file:/mnt/copy/t", None),
    "file:/mnt/dat/t": (None, None, "no location"),
    "other://x/1": (None, None, "no location"),
    "src://unknown/1": (None, None, "no location"),
    "abfss://c@acct.example/base/t/1": ("account", "abfss://c@other.example/base/t/1", None),
    None: (None, None, "no location"),
}


@pytest.mark.parametrize("limits", [FEW, MANY], ids=["few", "many"])
def test_remap(spark, limits):
    tables = spark.createDataFrame(
        [("c", "s", f"t{i}", path) for i, path in enumerate(CASES)],
        "catalog string, schema string, name string, storage_location string",
    )
    source = spark.createDataFrame(SOURCE, "name string, url string")
    target = spark.createDataFrame(TARGET, "name string, url string")
    moved = remap_locations(tables, source, target, limits=limits)
    got = {r.storage_location: (r.location_name, r.target_location, r.problem) for r in moved.collect()}
    assert got == CASES
    text = plan(moved)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_both_ways_agree_on_a_hot_root(spark):
    tables = spark.range(2000).selectExpr(
        "'c' as catalog", "'s' as schema", "concat('t', id) as name",
        "concat('src://r', if(id % 3 = 0, 0, id % 50), '/d', id % 7, '/', id) as storage_location",
    )
    source = spark.range(350).selectExpr(
        "concat('l', id) as name", "concat('src://r', id % 50, '/d', id div 50) as url"
    )
    target = source.selectExpr("name", "concat('dst://', name) as url")
    few = remap_locations(tables, source, target, limits=FEW)
    many = remap_locations(tables, source, target, limits=MANY)
    assert few.count() == 2000
    assert few.exceptAll(many).count() == 0 and many.exceptAll(few).count() == 0
    assert few.filter("problem is null").count() == 2000


def test_few_locations_do_not_shuffle_the_tables(spark):
    tables = spark.range(10).selectExpr("'c' catalog", "'s' schema", "'t' name", "'x://y/1' storage_location")
    locations = spark.createDataFrame([("a", "x://y")], "name string, url string")
    text = remap_locations(tables, locations, locations)._jdf.queryExecution().executedPlan().toString()
    # The only exchanges belong to the locations, below the broadcast.
    assert text.index("BroadcastExchange") < text.index("Exchange hashpartitioning")


def test_many_locations_are_not_broadcast(spark, tmp_path):
    """However small their files are: an estimate of the optimizer does not send them around."""
    spark.range(3000).selectExpr("concat('l', id) as name", "concat('src://r/', id) as url").write.parquet(
        str(tmp_path / "places")
    )
    places = spark.read.parquet(str(tmp_path / "places"))
    tables = places.selectExpr("name", "concat(url, '/t') as storage_location")
    moved = remap_locations(tables, places, places, limits=JoinLimits(broadcast_rows=1000))
    assert "Broadcast" not in plan(moved)
    assert moved.filter("problem is null and target_location = storage_location").count() == 3000


def test_pairs(spark):
    source = spark.createDataFrame(SOURCE, "name string, url string")
    target = spark.createDataFrame(TARGET, "name string, url string")
    pairs = {r.url: (r.name, r.target_url) for r in location_pairs(source, target).collect()}
    assert pairs["src://r3"] == ("twin_a", "dst://ta")
    assert pairs["src://r2"] == ("lost", None)
    assert "src:" not in pairs


def test_both_ways_agree_on_null_and_repeated_keys(spark):
    rows = [
        (None, None, "t", "src://q/1"), (None, None, "t", "src://r/1"), ("c", "s", "t", "src://q/1"),
        ("c", "s", "t", "src://q/1"), ("c", None, None, None), ("c", "s", "u", "src://none/1"),
    ]
    tables = spark.createDataFrame(rows, "catalog string, schema string, name string, storage_location string")
    source = spark.createDataFrame([("q", "src://q"), ("r", "src://r")], "name string, url string")
    target = spark.createDataFrame([("q", "dst://q"), ("r", "dst://r")], "name string, url string")
    few = remap_locations(tables, source, target, limits=FEW)
    many = remap_locations(tables, source, target, limits=MANY)
    assert few.exceptAll(many).count() == 0 and many.exceptAll(few).count() == 0
    moved = {r.storage_location: r.target_location for r in many.collect()}
    assert moved == {"src://q/1": "dst://q/1", "src://r/1": "dst://r/1", None: None, "src://none/1": None}
