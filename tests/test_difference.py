from __future__ import annotations

from collections import Counter

import pytest

from continuity.operators import difference as D
from continuity.plans.replicate import replicate_named
from continuity.workspace import run_database, run_folder
from tests.helpers import rows

DDL = "id bigint, s string, m array<int>"


def expected(left, right):
    a, b = (Counter((r.id, r.s, tuple(r.m or ())) for r in df.collect()) for df in (left, right))
    return {(*k, a[k], b[k]) for k in a | b if a[k] != b[k]}


def got(df):
    found = [(r.id, r.s, tuple(r.m or ()), r.n_left, r.n_right) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def table(spark, n=3000):
    return spark.range(0, n, 1, 4).selectExpr(
        "id", "if(id % 7 = 0, null, concat('s', id % 50)) as s", "array(cast(id as int), 1) as m"
    )


CHANGES = {
    "nothing": lambda df: df,
    "other order": lambda df: df.orderBy("s", "id"),
    "one value": lambda df: df.selectExpr("id", "if(id = 77, 'x', s) as s", "m"),
    "rows gone and new": lambda df: df.filter("id % 500 <> 3").union(df.filter("id < 3").selectExpr("-id - 1", "s", "m")),
    "copies": lambda df: df.union(df.filter("id in (5, 6)")).union(df.filter("id = 5")),
    "null and text": lambda df: df.selectExpr("id", "if(id = 7, '', s) as s", "m"),
    "everything": lambda df: df.selectExpr("id + 1000000 as id", "s", "m"),
    "empty": lambda df: df.limit(0),
}


@pytest.mark.parametrize("change", CHANGES)
def test_differences_are_found_exactly(spark, change):
    left = table(spark)
    left = left.union(left.filter("id = 9"))
    right = CHANGES[change](left)
    for levels in (1, 2) if change == "copies" else (2,):
        trees = D.digest_tree(left, levels=levels), D.digest_tree(right, levels=2)
        assert got(D.differing_rows(left, right, *trees)) == expected(left, right)


def test_many_ranges_and_files_are_joined(spark):
    left = table(spark, 600)
    right = left.filter("id % 2 = 0")
    folder = run_folder(spark, "sides")
    left.write.parquet(f"{folder}/l"), right.repartition(5).write.parquet(f"{folder}/r")
    sides = spark.read.parquet(f"{folder}/l"), spark.read.parquet(f"{folder}/r")
    assert got(D.differing_rows(*sides, named=3)) == expected(*sides)
    # Columns in another order are matched by name.
    assert got(D.differing_rows(sides[0], sides[1].select("m", "s", "id"))) == expected(*sides)
    with pytest.raises(ValueError, match="different columns"):
        D.differing_rows(sides[0], sides[1].select("id"))


def test_little_is_read_for_a_small_difference(spark):
    """After the first level only ranges, pages and files that differ are read."""
    folder = run_folder(spark, "big")
    spark.range(0, 400_000, 1, 4).selectExpr("id", "id % 9 as k").write.parquet(f"{folder}/l")
    left = spark.read.parquet(f"{folder}/l")
    left.selectExpr("id", "if(id = 250000, -1, k) as k").write.parquet(f"{folder}/r")
    right = spark.read.parquet(f"{folder}/r")
    trees = D.digest_tree(left, levels=2), D.digest_tree(right, levels=2)
    ranges, level = D.differing_ranges(*trees)
    assert level == 2 and 1 <= ranges.count() <= 2
    some = D.leaves_in(trees[0], ranges, level)
    plan = some._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    read = plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    # A page of 4,096 hashes in each of 8 files at most, of 400,000.
    assert 1 <= read <= 2 * 8 * 4096
    hashes = D.differing_hashes(*trees)
    assert hashes.count() == 2
    cut = D._in_files(left, trees[0], hashes.filter("n_left > 0").selectExpr("left_file as file"), 10)
    plan = cut._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert plan.collectLeaves().apply(0).metrics().apply("numFiles").value() == 1
    assert rows(D.differing_rows(left, right, *trees)) == {(250000, 7, 1, 0): 1, (250000, -1, 0, 1): 1}


def test_views_and_copies(spark):
    source, target = run_database(spark, "source"), run_database(spark, "target")
    table(spark, 100).write.saveAsTable(f"{source}.t")
    replicate_named(spark, f"{source}.t", f"{target}.t", run_folder(spark, "copies"))
    assert D.differing_rows(spark.table(f"{source}.t"), spark.table(f"{target}.t")).count() == 0
    spark.sql(f"CREATE VIEW {source}.v AS SELECT s, count(*) AS n FROM {source}.t GROUP BY s")
    spark.sql(f"CREATE VIEW {target}.v AS SELECT s, count(*) AS n FROM {target}.t WHERE id <> 8 GROUP BY s")
    found = D.differing_rows(spark.table(f"{source}.v"), spark.table(f"{target}.v"))
    assert rows(found) == {("s8", 2, 1, 0): 1, ("s8", 1, 0, 1): 1}
