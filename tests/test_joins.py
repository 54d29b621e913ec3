from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from continuity.operators.joins import (
    JoinLimits,
    estimated_bytes,
    fits_broadcast,
    hot_keys,
    input_bytes,
    keyed_join,
)
from tests.helpers import plan, rows

SHUFFLED = JoinLimits(broadcast_rows=0, broadcast_bytes=0, hot_rows=50, hot_share=20)
MEASURED = JoinLimits(broadcast_rows=1000, broadcast_bytes=1 << 20)


@pytest.fixture(scope="module")
def sides(spark):
    # Key 7 holds a third of the rows, -1 stands for a null key.
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 31 == 0, F.lit(None))
        .otherwise(F.col("id") % 200)
        .cast("int")
        .alias("k"),
        F.concat(F.lit("v"), F.col("id")).alias("v"),
    )
    lookup = spark.range(0, 300, 2).select(F.col("id").cast("int").alias("k"), "id").union(
        spark.createDataFrame([(7, 1), (7, 2), (None, 3)], "k int, id bigint")
    )
    return big, lookup


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limits", [JoinLimits(), MEASURED, SHUFFLED], ids=["auto", "measured", "salted"])
def test_every_way_gives_the_plain_join(sides, how, limits):
    big, lookup = sides
    joined = keyed_join(big, lookup, ["k"], how, spread_by=["v"], limits=limits)
    assert rows(joined) == rows(big.join(lookup, ["k"], how))
    assert ("__salt" in plan(joined)) == (limits is SHUFFLED)


def test_hot_keys_are_found(sides):
    big, _ = sides
    hot, salts = hot_keys(big, ["k"], SHUFFLED)
    seven = big.sparkSession.range(1).select(F.xxhash64(F.lit(7))).first()[0]
    assert hot == [seven] and salts >= 2
    assert hot_keys(big, ["v"], SHUFFLED) == ([], 1)


def test_salting_splits_the_hot_key(sides, spark):
    big, lookup = sides
    joined = keyed_join(big, lookup.filter("k = 7"), ["k"], spread_by=["v"], limits=SHUFFLED)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = joined.filter("k = 7").withColumn("task", F.spark_partition_id())
        assert again.select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_fits_broadcast_measures_rows_and_bytes(spark):
    df = spark.createDataFrame([("x" * 100, [1, 2])] * 10, "s string, a array<int>")
    assert fits_broadcast(df, JoinLimits(broadcast_rows=10, broadcast_bytes=5000))
    assert not fits_broadcast(df, JoinLimits(broadcast_rows=9, broadcast_bytes=5000))
    assert not fits_broadcast(df, JoinLimits(broadcast_rows=10, broadcast_bytes=500))
    assert fits_broadcast(df.limit(0), JoinLimits(broadcast_rows=0, broadcast_bytes=0))


def test_input_bytes_do_not_multiply(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    joined = part.join(part.withColumnRenamed("p_name", "n"), "p_partkey")
    assert input_bytes(joined) == 2 * input_bytes(part) < estimated_bytes(joined)
    assert not fits_broadcast(part, JoinLimits(measure_bytes=1))
    assert fits_broadcast(part, JoinLimits(measure_bytes=1), joined)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_an_estimate_broadcasts_nothing(spark, tmp_path, how):
    # 20,000 rows in a small file: below Spark's threshold, but more rows than are allowed.
    spark.range(20000).selectExpr("id as k", "'same' as w").write.parquet(str(tmp_path / "lookup"))
    lookup = spark.read.parquet(str(tmp_path / "lookup"))
    big = spark.range(0, 40000, 3).selectExpr("id as k", "concat('v', id) as v")
    assert estimated_bytes(lookup) < 1 << 20
    joined = keyed_join(big, lookup, ["k"], how, limits=MEASURED)
    assert "Broadcast" not in plan(joined)
    assert rows(joined) == rows(big.join(lookup, ["k"], how))
    assert "BroadcastHashJoin" in plan(keyed_join(big, lookup.limit(1000), ["k"], how, limits=MEASURED))


def test_unknown_join_type(sides):
    with pytest.raises(ValueError):
        keyed_join(*sides, ["k"], "full_outer")
