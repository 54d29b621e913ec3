from __future__ import annotations

import pytest

from continuity.functions import same_digest
from continuity.functions.digest import digest
from continuity.plans import replicate as R
from continuity.plans.status import StatusLog, failure, outcome, record
from continuity.sources.inventory import describe_table
from continuity.threads import run_each
from continuity.workspace import run_database, run_folder
from tests.helpers import rows

PLAN = (
    "catalog string, schema string, table string, kind string, source string, target string, "
    "format string, source_location string, target_location string, problem string"
)


@pytest.fixture
def place(spark):
    return run_database(spark, "source"), run_database(spark, "target"), run_folder(spark, "copies")


def rich(spark, n=50):
    return spark.range(0, n, 1, 2).selectExpr(
        "id", "id % 3 as part", "map('k', id, 'j', id + 1) as m",
        "array(struct(id as a, map(id, 'x') as b)) as nested",
        "if(id % 5 = 0, null, concat('s', id)) as s", "cast(id as decimal(20,3)) as d",
        "timestamp_ntz'2024-01-01 00:00:00.123456' + make_interval(0,0,0,0,0,0,id) as ts",
        "cast(cast(id as string) as binary) as b",
    )


def test_digest_is_multiset_true(spark):
    a = spark.createDataFrame([(1, None), (1, None), (None, 1)], "a int, b int")
    assert same_digest(a, a.orderBy("b").repartition(3))
    for other in ([(1, None), (None, 1)], [(None, 1), (None, 1), (1, None)], [(1, None), (1, None), (1, None)]):
        assert not same_digest(a, spark.createDataFrame(other, "a int, b int"))
    m = spark.sql("select map('a', 1, 'b', 2) as m")
    assert same_digest(m, spark.sql("select map('b', 2, 'a', 1) as m"))
    assert not same_digest(m, spark.sql("select map('b', 1, 'a', 2) as m"))
    assert digest(a.limit(0)) == {"rows": 0, "sum0": 0, "sum1": 0, "sum2": 0, "sum3": 0}


@pytest.mark.parametrize("layout", [(), ("part",)], ids=["flat", "partitioned"])
def test_copy_keeps_everything(spark, place, layout):
    source_db, target_db, folder = place
    source, target = f"{source_db}.t", f"{target_db}.t"
    rich(spark).write.partitionBy(*layout).saveAsTable(source)
    spark.sql(f"ALTER TABLE {source} SET TBLPROPERTIES ('a.b' = 'it''s')")
    spark.sql(f"COMMENT ON TABLE {source} IS 'hello'")
    R.replicate_named(spark, source, target, folder)
    assert spark.table(target).schema == spark.table(source).schema
    assert same_digest(spark.table(source), spark.table(target))
    facts = describe_table(spark, target)
    assert facts["comment"] == "hello"
    assert facts["table_properties"]["a.b"] == "it's"
    assert facts["table_properties"][R.KIND] == "MANAGED"
    assert tuple(facts.get("partition_columns") or ()) == layout
    first = facts["location"]

    # A second run switches to a new version, also when values and partitions went away.
    spark.sql(f"DROP TABLE {source}")
    rich(spark, 20).filter("part <> 1").write.partitionBy(*layout).saveAsTable(source)
    R.replicate_named(spark, source, target, folder)
    assert same_digest(spark.table(source), spark.table(target))
    assert describe_table(spark, target)["location"] != first

    # A copy of the copy is the same again and keeps the original kind.
    R.replicate_named(spark, target, f"{target_db}.u", folder + "_u")
    assert same_digest(spark.table(source), spark.table(f"{target_db}.u"))
    assert R.table_facts(spark, f"{target_db}.u").kind == "MANAGED"


def test_changed_schema_and_foreign_table_are_replaced(spark, place):
    source_db, target_db, folder = place
    source, target = f"{source_db}.t", f"{target_db}.t"
    spark.range(5).write.saveAsTable(target)
    spark.range(3).selectExpr("id", "'x' as extra").write.saveAsTable(source)
    R.replicate_named(spark, source, target, folder)
    assert spark.table(target).columns == ["id", "extra"]
    spark.sql(f"DROP TABLE {source}")
    spark.range(4).selectExpr("cast(id as int) as id").write.saveAsTable(source)
    R.replicate_named(spark, source, target, folder)
    assert spark.table(target).dtypes == [("id", "int")] and spark.table(target).count() == 4


def test_empty_table(spark, place):
    source_db, target_db, folder = place
    rich(spark, 0).write.saveAsTable(f"{source_db}.t")
    R.replicate_named(spark, f"{source_db}.t", f"{target_db}.t", folder)
    assert spark.table(f"{target_db}.t").count() == 0
    assert spark.table(f"{target_db}.t").schema == spark.table(f"{source_db}.t").schema


def test_copy_by_path_keeps_partitioning(spark, place):
    _, target_db, folder = place
    rich(spark).write.partitionBy("part").parquet(f"{folder}/in")
    R.replicate_path(spark, f"{folder}/in", f"{target_db}.t", f"{folder}/out")
    facts = describe_table(spark, f"{target_db}.t")
    assert facts["partition_columns"] == ["part"] and f"{folder}/out/v_" in facts["location"]
    given = spark.read.parquet(f"{folder}/in")
    given = given.withColumn("part", given["part"].cast("string"))
    assert same_digest(given, spark.table(f"{target_db}.t"))


def test_values_in_folder_names_stay_as_written(spark, place):
    _, target_db, folder = place
    keys = spark.range(4).selectExpr("id", "lpad(cast(id as string), 3, '0') as key")
    keys.write.partitionBy("key").parquet(f"{folder}/keys")
    R.replicate_path(spark, f"{folder}/keys", f"{target_db}.k", f"{folder}/keys_out")
    assert same_digest(keys, spark.table(f"{target_db}.k"))


def test_properties_gone_from_the_source_go_from_the_copy(spark, place):
    source_db, target_db, folder = place
    source, target = f"{source_db}.props", f"{target_db}.props"
    spark.range(3).write.saveAsTable(source)
    spark.sql(f"ALTER TABLE {source} SET TBLPROPERTIES ('team' = 'a', 'tier' = 'b')")
    R.replicate_named(spark, source, target, f"{folder}/props", skip_unchanged=True)
    spark.sql(f"ALTER TABLE {source} UNSET TBLPROPERTIES ('tier')")
    R.replicate_named(spark, source, target, f"{folder}/props", skip_unchanged=True)
    held = describe_table(spark, target)["table_properties"]
    assert held["team"] == "a" and "tier" not in held
    where = describe_table(spark, target)["location"]
    R.replicate_named(spark, source, target, f"{folder}/props", skip_unchanged=True)
    assert describe_table(spark, target)["location"] == where


@pytest.mark.parametrize("source_fmt, kept", [("orc", "orc"), ("json", "parquet")])
def test_format_of_the_copy(spark, place, source_fmt, kept):
    source_db, target_db, folder = place
    source = f"{source_db}.t"
    spark.range(9).selectExpr("id", "cast(id as string) as s").write.format(source_fmt).saveAsTable(source)
    R.replicate_named(spark, source, f"{target_db}.n", f"{folder}/n")
    R.replicate_path(spark, describe_table(spark, source)["location"], f"{target_db}.p", f"{folder}/p", source_fmt)
    for name in ("n", "p"):
        assert describe_table(spark, f"{target_db}.{name}")["provider"] == kept
        assert same_digest(spark.table(source), spark.table(f"{target_db}.{name}"))


def test_new_layout_is_clustered(spark, place):
    _, target_db, folder = place
    facts = R.TableFacts(partition_by=("part",))
    df = rich(spark, 300).repartition(8)
    R.replicate(spark, df, f"{target_db}.t", folder, facts, same_layout=False)
    assert same_digest(df, spark.table(f"{target_db}.t"))
    files = spark.table(f"{target_db}.t").select("_metadata.file_path").distinct().count()
    assert files == 3


@pytest.mark.parametrize("layout", [(), ("part",)], ids=["flat", "partitioned"])
def test_unchanged_source_is_skipped(spark, place, layout):
    source_db, target_db, folder = place
    source, target = f"{source_db}.t", f"{target_db}.t"
    rich(spark).write.partitionBy(*layout).saveAsTable(source)

    def run():
        R.replicate_named(spark, source, target, folder, skip_unchanged=True)
        assert same_digest(spark.table(source), spark.table(target))
        return describe_table(spark, target)["location"]

    first = run()
    assert run() == first
    spark.sql(f"COMMENT ON TABLE {source} IS 'new'")
    second = run()
    assert second != first and run() == second
    assert describe_table(spark, target)["comment"] == "new"
    rich(spark, 4).select(*spark.table(source).columns).write.insertInto(source)
    third = run()
    assert third != second and run() == third
    # A plain run always copies, and leaves nothing that a later run could take for current.
    R.replicate_named(spark, source, target, folder)
    fourth = describe_table(spark, target)["location"]
    assert fourth != third and run() != fourth


def test_failed_copy_leaves_the_old_version(spark, place, monkeypatch):
    source_db, target_db, folder = place
    source, target = f"{source_db}.t", f"{target_db}.t"
    spark.range(5).write.saveAsTable(source)
    R.replicate_named(spark, source, target, folder)
    spark.range(5).write.insertInto(source)
    with monkeypatch.context() as broken:
        seen = iter([{"rows": 1}, {"rows": 2}])
        broken.setattr(R, "digest", lambda df: next(seen))
        with pytest.raises(RuntimeError, match="differs"):
            R.replicate_named(spark, source, target, folder)
    assert spark.table(target).count() == 5


def test_doubtful_counters_are_checked_with_the_source(spark, place, monkeypatch):
    """Counters of tasks that ran twice: the source decides, and the copy goes through."""
    source_db, target_db, folder = place
    spark.range(5).write.saveAsTable(f"{source_db}.t")
    monkeypatch.setattr(R, "normal", lambda seen: {"rows": 10, "sum0": 0, "sum1": 0, "sum2": 0, "sum3": 0})
    R.replicate_named(spark, f"{source_db}.t", f"{target_db}.t", folder)
    assert spark.table(f"{target_db}.t").count() == 5


def test_a_source_without_files_is_always_copied(spark, place):
    source_db, target_db, folder = place
    spark.range(6).write.saveAsTable(f"{source_db}.base")
    spark.sql(f"CREATE VIEW {source_db}.v AS SELECT id % 2 AS k, count(*) AS n FROM {source_db}.base GROUP BY 1")
    assert R.source_files(spark.table(f"{source_db}.v")) is None
    for _ in range(2):
        R.replicate_named(spark, f"{source_db}.v", f"{target_db}.t", folder, skip_unchanged=True)
    assert rows(spark.table(f"{target_db}.t")) == {(0, 3): 1, (1, 3): 1}


def test_refusals(spark, place):
    source_db, target_db, folder = place
    source = f"{source_db}.t"
    spark.range(5).write.saveAsTable(source)
    spark.sql(f"CREATE VIEW {target_db}.v AS SELECT 1 AS id")
    with pytest.raises(RuntimeError, match="is a view"):
        R.replicate_named(spark, source, f"{target_db}.v", folder)
    location = describe_table(spark, source)["location"]
    with pytest.raises(RuntimeError, match="inside the source"):
        R.replicate_named(spark, source, f"{target_db}.t", f"{location}/copy")
    with pytest.raises(RuntimeError, match="own source"):
        R.replicate_named(spark, source, source, folder)
    assert spark.table(source).count() == 5


def test_plan_isolates_failures(spark, place):
    source_db, target_db, folder = place
    spark.range(5).write.saveAsTable(f"{source_db}.good")
    spark.range(4).write.parquet(f"{folder}/in")

    def row(table, kind, source=None, where=None, to=None, problem=None):
        return ("main", "s", table, kind, source, table, "parquet", where, to, problem)

    plan = spark.createDataFrame(
        [
            row("good", "name", "good"),
            row("absent", "name", "absent"),
            row("moved", "path", where=f"{folder}/in", to=f"{folder}/out"),
            row("missing_path", "path", where=f"{folder}/nowhere", to=f"{folder}/x"),
            row("unwritable", "path", where=f"{folder}/in", to="/proc/nowhere"),
            row("homeless", "path", problem="no location"),
            row("lost", "path", where=f"{folder}/in", problem="no target location"),
        ],
        PLAN,
    )

    def run(fail_fast=False):
        log = StatusLog(spark, batch=2)
        R.run_clone_plan(
            spark, plan, log,
            source_of=lambda r: f"{source_db}.{r.source}",
            target_of=lambda r: f"{target_db}.{r.table}",
            folder_of=lambda r: f"{folder}/tables/{r.table}",
            workers=3, fail_fast=fail_fast,
        )
        return log.frame()

    status = run()
    text = {r.table: r.status for r in status.collect()}
    assert text["good"] == text["moved"] == "SUCCESS"
    assert text["homeless"] == "FAIL: no location" and text["lost"] == "FAIL: no target location"
    for name in ("absent", "missing_path", "unwritable"):
        assert text[name].startswith("FAIL: ") and len(text[name]) > 10
    assert rows(status.groupBy(outcome().alias("o")).count()) == {("SUCCESS", 2): 1, ("FAIL", 5): 1}
    assert spark.table(f"{target_db}.good").count() == 5
    assert spark.table(f"{target_db}.moved").count() == 4
    with pytest.raises(Exception):
        run(fail_fast=True)


def test_run_each_keeps_few_items_in_flight():
    drawn, seen = [], []

    def items():
        for i in range(20):
            drawn.append(i)
            yield i

    for done in run_each(lambda i: i, items(), workers=3):
        assert len(drawn) - len(seen) <= 4
        seen.append(done)
    assert sorted(seen) == list(range(20))


def test_status_log(spark):
    log = StatusLog(spark, batch=2)
    for i in range(5):
        log.add(record("c", "s", f"t{i}", "view", "SUCCESS"))
    assert len(log._waiting) == 1
    frame = log.frame()
    assert frame.count() == 5 and frame.filter("sync_time > 1600000000000000000").count() == 5
    assert failure(ValueError()) == "FAIL: ValueError" and failure("a\nb") == "FAIL: a\nb"
