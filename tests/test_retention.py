from __future__ import annotations

import datetime
import os
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from continuity.functions import quote, same_digest
from continuity.plans.replicate import INDEX, replicate_named, replicate_path, write_version
from continuity.plans.retention import remove_unused, unused_versions, versions_in_use
from continuity.workspace import run_database, run_folder

NOW = datetime.timedelta(0)


@pytest.fixture
def home(spark):
    return run_database(spark, "kept"), run_folder(spark, "home of copies")


def folders(df):
    return sorted(r.folder for r in df.collect())


def age(folder, days):
    for path in Path(folder.removeprefix("file:")).rglob("*"):
        then = path.stat().st_mtime - days * 86400
        os.utime(path, (then, then))


def test_old_versions_go_and_a_copy_in_flight_stays(spark, home):
    database, folder = home
    source, target = f"{folder}/src", quote(database, "t")
    for n in (3, 4, 5):
        spark.range(n).write.mode("overwrite").parquet(source)
        replicate_path(spark, source, target, f"{folder}/c/t")
    assert len(folders(unused_versions(spark, folder, [database], NOW))) == 2
    assert folders(unused_versions(spark, folder, [database])) == []
    age(f"{folder}/c", 30)
    # Written and not yet published: only its age tells that it is not waste.
    flying, _ = write_version(spark.range(9), f"{folder}/c/t")
    unused = folders(unused_versions(spark, folder, [database]))
    assert len(unused) == 2 and all(u.startswith("c/t/v_") for u in unused)
    told = remove_unused(spark, folder, [database]).collect()
    assert {r.status for r in told} == {"UNUSED"} and len(told) == 2
    gone = remove_unused(spark, folder, [database], dry_run=False).collect()
    assert sorted(r.folder for r in gone) == unused and {r.status for r in gone} == {"REMOVED"}
    assert all(r.n_files > 0 and r.bytes > 0 for r in gone)
    assert not any(Path(f"{folder.removeprefix('file:')}/{u}").exists() for u in unused)
    assert spark.table(target).count() == 5 and spark.read.parquet(flying).count() == 9
    assert spark.read.parquet(source).count() == 5
    assert remove_unused(spark, folder, [database], dry_run=False).count() == 0


def test_versions_that_partitions_point_into_stay(spark, home):
    database, folder = home
    source, target = quote(database, "src"), quote(database, "t")
    spark.range(40).selectExpr("id", "id % 4 as p").write.partitionBy("p").saveAsTable(source)
    copy = f"{folder}/t"
    replicate_named(spark, source, target, copy, skip_unchanged=True)
    for part in (1, 2):
        spark.sql(f"INSERT INTO {source} VALUES (100, {part})")
        replicate_named(spark, source, target, copy, skip_unchanged=True)
    # Three versions hold partitions; two indexes are old.
    assert versions_in_use(spark, [database]).count() == 4
    unused = folders(unused_versions(spark, folder, [database], NOW))
    assert len(unused) == 2 and all(u.startswith("t/index/v_") for u in unused)
    remove_unused(spark, folder, [database], NOW, dry_run=False)
    spark.catalog.refreshTable(target)
    assert same_digest(spark.table(source), spark.table(target))
    # The next copy still knows what it has.
    assert replicate_named(spark, source, target, copy, skip_unchanged=True).kept == 4


def test_a_version_in_another_one_and_an_index_that_is_lost(spark, home):
    database, folder = home
    outer, _ = write_version(spark.range(3), f"{folder}/a")
    spark.range(2).write.parquet(f"{folder}/src")
    replicate_path(spark, f"{folder}/src", quote(database, "inner"), f"{outer}/b")
    assert folders(unused_versions(spark, folder, [database], NOW)) == []
    spark.sql(f"DROP TABLE {quote(database, 'inner')}")
    assert folders(unused_versions(spark, folder, [database], NOW)) == ["a/" + outer.rsplit("/", 1)[1]]
    spark.sql(
        f"CREATE TABLE {quote(database, 'lost')} (id bigint) USING parquet LOCATION '{folder}/x' "
        f"TBLPROPERTIES ('{INDEX}' = '{folder}/absent')"
    )
    with pytest.raises(AnalysisException):
        unused_versions(spark, folder, [database], NOW)
