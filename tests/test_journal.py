from __future__ import annotations

from dataclasses import replace
from pathlib import Path

import pytest

from continuity.functions import same_digest
from continuity.plans import replicate as R
from continuity.plans.journal import Journal
from continuity.plans.status import record
from continuity.plans.sync import run_logged, run_sync
from continuity.workspace import run_folder
from tests.helpers import rows
from tests.test_sync import estate  # noqa: F401


class Stopped(BaseException):
    """Not an error of an object, so nothing catches it."""


class Stopping(Journal):
    """Stops the run before or after some of its events."""

    def __init__(self, spark, folder, events, before):
        super().__init__(spark, folder)
        self.left, self.before = events, before

    def _event(self, phase, status):
        if self.before and self.left == 0:
            raise Stopped
        super()._event(phase, status)
        self.left -= 1
        if self.left == 0 and not self.before:
            raise Stopped


def versions(folder):
    return sorted(str(p.relative_to(folder).parent) for p in Path(folder).rglob("v_*") if p.is_dir() and p.parent.name != "index")


def told(result):
    status = rows(result.status.select("catalog", "schema", "table", "kind", "status"))
    # Messages name run folders and times.
    return {tuple(c if c is None or not str(c).startswith("FAIL") else "FAIL" for c in k): n for k, n in status.items()}


def test_a_run_stopped_again_and_again_ends_as_an_undisturbed_one(spark, estate, monkeypatch):  # noqa: F811
    source, target, folder, ours, theirs, options = estate
    plain = run_sync(spark, ours, theirs, replace(options, folder=f"{folder}/plain"))
    expected = told(plain), rows(plain.grants), rows(plain.volumes)
    for name in ("m", "e"):
        spark.sql(f"DROP TABLE {target['main']}.{name}")
    for name in ("v1", "v2"):
        spark.sql(f"DROP VIEW {target['main']}.{name}")
    copied = []
    written = R._write
    monkeypatch.setattr(R, "_write", lambda df, version, *more: (copied.append(version), written(df, version, *more))[1])
    starts = 0
    journal = f"{folder}/journal"
    while True:
        log = Stopping(spark, journal, 4, before=starts % 2 == 0)
        starts += 1
        try:
            # The second start lists the target anew, with what the first one made.
            listed = theirs if starts == 1 else replace(theirs, schemas=ours.schemas, tables=ours.tables)
            result = run_logged(spark, ours, listed, options, log)
            break
        except Stopped:
            assert starts < 20
    assert starts > 2
    assert (told(result), rows(result.grants), rows(result.volumes)) == expected
    assert len(copied) == 2 and versions(f"{folder}/replica") == ["tables/main/s/m"]
    assert same_digest(spark.table(f"{source['main']}.m"), spark.table(f"{target['main']}.m"))
    assert spark.table(f"{target['main']}.v2").count() == 30

    # Once more: nothing is done, all is told.
    again = run_sync(spark, ours, theirs, replace(options, journal=journal))
    assert told(again) == expected[0] and len(copied) == 2
    assert Journal(spark, journal).unfinished().count() == 0


def test_a_copy_that_no_event_tells_of_is_not_made_again(spark, estate):  # noqa: F811
    *_, ours, theirs, options = estate
    journal = f"{options.folder}/j"
    run_sync(spark, ours, theirs, replace(options, journal=journal))
    before = versions(options.folder)
    for event in Path(journal, "events").glob("*.json"):
        if '"end"' in event.read_text():
            event.write_text("")
    log = Journal(spark, journal)
    assert ("main", "s", "m", "table_by_name") in rows(log.unfinished())
    result = run_logged(spark, ours, theirs, options, log)
    assert versions(options.folder) == before
    status = {r.table: r.status for r in result.status.filter("kind = 'table_by_name'").collect()}
    assert status["m"] == "SUCCESS"


def test_events_and_frames(spark):
    folder = run_folder(spark, "journal")
    log = Journal(spark, folder)
    assert not log.resumed and log.frame().count() == 0
    plan = spark.createDataFrame([("c", "s", "t"), ("c", "s", "u"), ("c", None, "t")], "catalog string, schema string, table string")
    assert log.remaining(plan, "k", "table").count() == 3
    log.begin(record("c", "s", "t", "k", None))
    log.add(record("c", "s", "t", "k", "SUCCESS"))
    log.begin(record("c", "s", "u", "k", None))
    log.add(record("c", None, "t", "k", "FAIL: once"))
    assert log.once("x", spark.range(3)).count() == 3
    Path(folder, "x", "_SUCCESS").unlink()

    again = Journal(spark, folder)
    assert again.resumed and again.run == log.run
    assert rows(again.remaining(plan, "k", "table")) == {("c", "s", "u"): 1}
    assert again.remaining(plan, "other", "table").count() == 3
    assert rows(again.unfinished()) == {("c", "s", "u", "k"): 1}
    # What was stopped half-way is written again, what is complete stays.
    assert again.once("x", spark.range(5)).count() == 5
    assert again.once("x", spark.range(9)).count() == 5
    eager = Journal(spark, folder, retry_failed=True)
    assert rows(eager.remaining(plan, "k", "table")) == {("c", "s", "u"): 1, ("c", None, "t"): 1}
    eager.add(record("c", None, "t", "k", "SUCCESS"))
    assert {r.status for r in eager.frame().collect()} == {"SUCCESS"}


@pytest.mark.parametrize("phase", ["begin", "end"])
def test_half_written_events_do_not_count(spark, phase):
    folder = run_folder(spark, "journal")
    log = Journal(spark, folder)
    Path(folder, "events", "_half").write_text('{"phase": "%s", "catalog": "c"' % phase)
    assert log._all_events().count() == 0
