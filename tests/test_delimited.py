from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from continuity.functions import audit_columns, delay_type
from continuity.schemas import flight_schema
from continuity.sinks import append
from continuity.sources import read_batch, read_stream
from continuity.streaming import append_stream
from continuity.workload import queries
from continuity.workload.inputs import flights, load
from continuity.workspace import run_database
from tests.helpers import rows

NAMES = flight_schema().names


def line(**changed):
    cells = {f.name: "1" if f.dataType.simpleString() == "int" else "NA" for f in flight_schema()}
    return ",".join(str((cells | changed)[n]) for n in NAMES)


def write(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(text + "\n" for text in lines))


def test_malformed_lines(spark, tmp_path):
    folder = tmp_path / "in"
    write(
        folder,
        "a.csv",
        line(FlightNum=1),
        line(FlightNum=2, Year="x"),
        ",".join(line(FlightNum=3).split(",")[:10]),
        line(FlightNum=4) + ",more,cells",
        line(FlightNum=5, WeatherDelay=""),
        ",".join(NAMES),
    )
    df = read_batch(spark, str(folder))
    assert df.schema == flight_schema()
    got = {r.FlightNum: r for r in df.collect()}
    assert got[1].Year == 1 and got[1].IsDepDelayed == "NA"
    assert got[2].Year is None and got[2].Month == 1
    assert got[3].TailNum is None and got[3].IsDepDelayed is None
    assert got[4].IsDepDelayed == "NA"
    assert got[5].WeatherDelay is None
    header = got[None]
    assert header.Year is None and header.WeatherDelay == "WeatherDelay"
    assert delay_type(df).filter("FlightNum is null").first().delay_type == "WeatherDelay"


def test_header_option(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", ",".join(NAMES), line(FlightNum=9))
    assert [r.FlightNum for r in read_batch(spark, str(folder), header=True).collect()] == [9]


def test_no_job_is_spent_on_the_schema(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", line())
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    read_batch(spark, str(folder))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_audit_columns(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", line(FlightNum=1))
    write(folder, "b.csv", line(FlightNum=2))
    timed = audit_columns(read_batch(spark, str(folder)).limit(10))
    kinds = dict(timed.dtypes)
    assert kinds["last_updated_time"] == "timestamp" and "last_updated_date" not in kinds
    files = {r.FlightNum: r.source_file.rsplit("/", 1)[1] for r in timed.collect()}
    assert files == {1: "a.csv", 2: "b.csv"}
    assert timed.select("last_updated_time").distinct().count() == 1
    dated = dict(audit_columns(read_batch(spark, str(folder)), include_time=False).dtypes)
    assert dated["last_updated_date"] == "date" and "last_updated_time" not in dated


def test_audit_needs_a_file_scan(spark):
    with pytest.raises(AnalysisException):
        audit_columns(spark.range(1))


def test_stream_equals_batch_and_takes_each_file_once(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    write(folder, "a.csv", line(FlightNum=1, WeatherDelay=3), line(FlightNum=2))
    write(folder, "b.csv", line(FlightNum=3, IsArrDelayed="YES"))
    table = f"{run_database(spark, 'stream')}.flights"

    def run():
        stream = read_stream(spark, str(folder), max_files_per_trigger=1)
        labelled = stream.transform(delay_type).transform(audit_columns)
        query = append(labelled, table, streaming=True, checkpoint_location=checkpoint)
        query.awaitTermination()
        return query

    def batch():
        return read_batch(spark, str(folder)).transform(delay_type).transform(audit_columns)

    query = run()
    assert not query.isActive and query.exception() is None
    assert rows(spark.table(table).drop("last_updated_time")) == rows(batch().drop("last_updated_time"))
    run()
    assert spark.table(table).count() == 3
    write(folder, "c.csv", line(FlightNum=4))
    run()
    assert rows(spark.table(table).drop("last_updated_time")) == rows(batch().drop("last_updated_time"))


def test_stream_limits_exclude_each_other(spark, tmp_path):
    with pytest.raises(ValueError):
        read_stream(spark, str(tmp_path), max_files_per_trigger=1, max_bytes_per_trigger=1)


def test_stream_needs_a_checkpoint(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = read_stream(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError):
        append(stream, "t", streaming=True)


def test_continuous_stream_keeps_running(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, "a.csv", line(FlightNum=1))
    table = f"{run_database(spark, 'stream')}.flights"
    query = append_stream(
        read_stream(spark, str(folder)), table, str(tmp_path / "c"), available_now=False
    )
    try:
        query.processAllAvailable()
        assert query.isActive
        write(folder, "b.csv", line(FlightNum=2))
        query.processAllAvailable()
        assert spark.table(table).count() == 2
    finally:
        query.stop()


def test_append_contract(spark):
    table = f"{run_database(spark, 'append')}.t"
    append(spark.createDataFrame([(1, "x")], "a int, b string"), table)
    append(spark.createDataFrame([("y", 2)], "b string, a int"), table)
    assert rows(spark.table(table)) == {(1, "x"): 1, (2, "y"): 1}
    with pytest.raises(AnalysisException):
        append(spark.createDataFrame([(1,)], "a int"), table)
    with pytest.raises(AnalysisException):
        append(spark.createDataFrame([(1, "x")], "a int, b string"), table, fmt="orc")
    append(spark.createDataFrame([(1, "x")], "a int, b string"), table)
    assert spark.table(table).filter("a = 1").count() == 2


def test_append_keeps_partitioning(spark):
    table = f"{run_database(spark, 'append')}.t"
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    for _ in range(2):
        append(df, table, partition_by=("b",))
    assert rows(spark.table(table).filter(F.col("b") == "x")) == {(1, "x"): 2}


def test_flight_files_are_packed_and_many(spark, tmp_path, monkeypatch):
    items = spark.range(0, 1000, 1, 1).selectExpr(
        "id as l_orderkey", "id % 50 as l_partkey", "id % 9 as l_suppkey", "cast(id % 7 as int) as l_linenumber",
        "cast(id % 50 as double) as l_quantity", "cast(id as double) as l_extendedprice",
        "id % 10 / 100D as l_discount", "id % 3 / 100D as l_tax", "if(id % 5 = 0, null, 'R') as l_returnflag",
        "if(id % 2 = 0, 'F', 'O') as l_linestatus",
        "timestamp'1995-01-01' + make_dt_interval(cast(id as int)) as l_shipdate",
    )
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(queries, "_LINES_PER_FILE", 300)
    folder = Path(queries._flight_files(spark, str(tmp_path)).removeprefix("file:"))
    files = sorted(folder.glob("part-*"))
    assert len(files) == 4 and all(f.name.endswith(".csv.gz") for f in files)
    whole = flights(load(spark, str(tmp_path), "lineitem"))
    assert rows(read_batch(spark, str(folder))) == rows(whole)
    assert sum(f.stat().st_size for f in files) * 2 < sum(len(",".join(map(str, r))) for r in whole.collect())
