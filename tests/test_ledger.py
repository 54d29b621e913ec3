from __future__ import annotations

from pathlib import Path

import pytest

from continuity.files import Files
from continuity.sinks import ledger as S
from continuity.sources.inventory import describe_table
from continuity.workspace import run_database, run_folder
from tests.helpers import rows


@pytest.fixture
def table(spark):
    return f"{run_database(spark, 'ledger')}.t"


def batch(spark, start, n=5):
    return spark.range(start, start + n).selectExpr("id", "concat('v', id) as v")


def test_a_repeated_batch_adds_nothing(spark, table):
    assert S.append_once(batch(spark, 0), table, "files", "a")
    assert S.append_once(batch(spark, 10), table, "files", "b")
    assert not S.append_once(batch(spark, 0), table, "files", "a")
    # The key counts, whatever the rows; another source has keys of its own.
    assert not S.append_once(batch(spark, 90), table, "files", "b")
    assert S.append_once(batch(spark, 0), table, "other", "a")
    assert S.append_once(batch(spark, 0, 0), table, "files", "none")
    assert spark.table(table).count() == 15
    told = rows(S.batch_ledger(spark, table).select("source", "batch", "rows"))
    assert told == {("files", "a", 5): 1, ("files", "b", 5): 1, ("other", "a", 5): 1, ("files", "none", 0): 1}


@pytest.mark.parametrize("at", ["write", "rename", "ledger"])
def test_a_batch_that_was_killed_comes_in_once(spark, table, monkeypatch, at):
    S.append_once(batch(spark, 0), table, "files", "first")

    class Killed(BaseException):
        pass

    def kill(*args):
        raise Killed

    df = batch(spark, 10)
    with monkeypatch.context() as broken:
        if at == "write":
            df = df.selectExpr("if(id = 13, raise_error('x'), id) as id", "v").selectExpr("cast(id as bigint) id", "v")
        elif at == "rename":
            broken.setattr(Files, "rename_new", kill)
        else:
            broken.setattr(S, "_enter", kill)
        with pytest.raises((Killed, Exception)):
            S.append_once(df, table, "files", "second")
    assert spark.table(table).count() == (10 if at == "ledger" else 5)
    assert S.append_once(batch(spark, 10), table, "files", "second") == (at != "ledger")
    assert spark.table(table).count() == 10
    assert rows(S.batch_ledger(spark, table).select("batch")) == {("first",): 1, ("second",): 1}


def test_two_attempts_at_once(spark, table, monkeypatch):
    """The other attempt gets the name while this one writes."""
    S.create_table(batch(spark, 0), table)
    renamed = Files.rename_new

    def late(self, name, new):
        if name.startswith("_staging"):
            monkeypatch.setattr(Files, "rename_new", renamed)
            assert S.append_once(batch(spark, 0), table, "files", "a")
        return renamed(self, name, new)

    monkeypatch.setattr(Files, "rename_new", late)
    assert not S.append_once(batch(spark, 0), table, "files", "a")
    assert spark.table(table).count() == 5
    home = describe_table(spark, table)["location"].removeprefix("file:")
    assert list(Path(home, "_staging").iterdir()) == []


def test_contract(spark, table):
    S.append_once(batch(spark, 0), table, "s", "1")
    S.append_once(batch(spark, 5).select("v", "id"), table, "s", "2")
    assert spark.table(table).filter("v = concat('v', id)").count() == 10
    for other in (batch(spark, 0).select("id"), batch(spark, 0).selectExpr("cast(id as int) id", "v")):
        with pytest.raises(ValueError, match="do not fit"):
            S.append_once(other, table, "s", "3")
    batch(spark, 0).write.saveAsTable(table + "_plain")
    with pytest.raises(ValueError, match="repeatable"):
        S.append_once(batch(spark, 0), table + "_plain", "s", "1")
    S.create_table(batch(spark, 0), table + "_empty")
    assert S.batch_ledger(spark, table + "_empty").count() == 0


def test_a_stream_killed_after_its_batch(spark, table, monkeypatch):
    folder = run_folder(spark, "stream")
    batch(spark, 0, 20).repartition(4).write.csv(f"{folder}/in")

    def stream():
        df = spark.readStream.schema("id bigint, v string").option("maxFilesPerTrigger", 1).csv(f"{folder}/in")
        return S.append_stream_once(df, table, f"{folder}/checkpoint")

    entered, calls = S._enter, []

    def kill(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("killed")
        entered(*args)

    with monkeypatch.context() as broken:
        broken.setattr(S, "_enter", kill)
        with pytest.raises(Exception, match="killed"):
            stream().awaitTermination()
    assert 0 < spark.table(table).count() < 20
    for _ in range(2):
        stream().awaitTermination()
        assert rows(spark.table(table).select("id")) == {(k,): 1 for k in range(20)}
    # The checkpoint forgets the last batch's end: it is run again.
    last = max(Path(folder, "checkpoint", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    Path(last.parent, f".{last.name}.crc").unlink(missing_ok=True)
    stream().awaitTermination()
    assert spark.table(table).count() == 20
    with pytest.raises(ValueError, match="checkpoint"):
        S.append_stream_once(spark.table(table), table, "")
