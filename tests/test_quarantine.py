from __future__ import annotations

import csv
import random
from pathlib import Path

import pytest

from continuity.sources import quarantine as Q
from continuity.workspace import run_database, run_folder
from tests.helpers import rows

DDL = "a int, s string, d double, day date, t string"


def written(folder, lines):
    Path(folder).mkdir(parents=True)
    half = len(lines) // 2
    for name, some in (("x.csv", lines[:half]), ("y.csv", lines[half:])):
        Path(folder, name).write_text("\n".join(some) + "\n")
    return str(folder)


CASES = {
    "1,x,2.5,2024-01-02,z": None,
    "1,x,2.5,2024-01-02,": None,
    ",,,,": None,
    '-7,"a,b",1e3,2024-12-31,"c""d"': None,
    "one,x,2.5,2024-01-02,z": "a: 'one' is no int",
    " 1,x,2.5,2024-01-02,z": "a: ' 1' is no int",
    "99999999999,x,2.5,2024-01-02,z": "a: '99999999999' is no int",
    "one,x,two,someday,z": "a: 'one' is no int; d: 'two' is no double; day: 'someday' is no date",
    "1,x": "too few cells: 2 of 5",
    "one": "too few cells: 1 of 5; a: 'one' is no int",
    "1,x,2.5,2024-01-02,z,": "too many cells: 6 of 5",
    "1,x,2.5,2024-01-02,z,w,v": "too many cells: 7 of 5",
    '1,"a,b",2.5': "too few cells: 3 of 5",
    "a,s,d,day,t": "a: 'a' is no int; d: 'd' is no double; day: 'day' is no date",
}


def test_every_line_is_a_good_row_or_a_bad_line(spark, tmp_path):
    lines = [line for line in CASES for _ in range(3)]
    random.Random(1).shuffle(lines)
    judged = Q.read_judged(spark, written(tmp_path / "in", lines), DDL, escape='"')
    bad, good = Q.bad_lines(judged), Q.good_rows(judged)
    assert rows(bad.select("line", "reason")) == {(k, v): 3 for k, v in CASES.items() if v}
    assert {r.source_file.rsplit("/", 1)[1] for r in bad.collect()} == {"x.csv", "y.csv"}
    # Counting alone finds the same, though it wants no column.
    assert good.count() == 12 and bad.count() == len(lines) - 12
    assert good.columns == ["a", "s", "d", "day", "t"]
    assert rows(good.select("a", "s", "t")) == {(1, "x", "z"): 3, (1, "x", None): 3, (None, None, None): 3, (-7, "a,b", 'c"d'): 3}
    assert good.select("s").count() == 12


def test_other_marks(spark, tmp_path):
    path = written(tmp_path / "in", ["1|'a|b'|2.5", "1|'a\\'|b'|2.5", "1|'a|b'", "x|y|2"])
    judged = Q.read_judged(spark, path, "a int, s string, d double", sep="|", quote="'")
    assert rows(Q.bad_lines(judged).select("reason")) == {("too few cells: 2 of 3",): 1, ("a: 'x' is no int",): 1}
    assert Q.good_rows(judged).count() == 2
    with pytest.raises(ValueError, match="multiline"):
        Q.read_judged(spark, path, DDL, multiLine="true")


def test_random_lines_against_a_plain_reader(spark, tmp_path):
    rng = random.Random(3)
    cells = ["1", "-2", "x", "", "2.5", "a b"]
    lines = [",".join(rng.choice(cells) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    lines = [line for line in lines if line]

    def kind(text, number):
        if text == "":
            return True
        try:
            number(text)
        except ValueError:
            return False
        return True

    def faults(line):
        got = next(csv.reader([line]))
        count = [] if len(got) == 3 else [f"too {'few' if len(got) < 3 else 'many'} cells: {len(got)} of 3"]
        got = (got + ["", ""])[:3]
        wrong = [f"{n}: '{c}' is no {t}" for n, c, t, f in zip("abc", got, ("int", "double", "x"), (int, float, str)) if not kind(c, f)]
        return "; ".join(count + wrong) or None

    judged = Q.read_judged(spark, written(tmp_path / "in", lines), "a int, b double, c string")
    expected = {}
    for line in lines:
        if faults(line):
            expected[(line, faults(line))] = expected.get((line, faults(line)), 0) + 1
    assert rows(Q.bad_lines(judged).select("line", "reason")) == expected
    assert Q.good_rows(judged).count() == len(lines) - sum(expected.values())


def test_a_stream_stopped_between_the_two_tables(spark, tmp_path, monkeypatch):
    database = run_database(spark, "quarantine")
    path = written(tmp_path / "in", list(CASES))
    tables = f"{database}.good", f"{database}.bad"
    folder = run_folder(spark, "checkpoint")

    def stream():
        Q.append_split_stream(spark, path, *tables, folder, DDL, max_files_per_trigger=1, escape='"').awaitTermination()

    once, calls = Q.append_once, []

    def dies(*args):
        calls.append(args)
        if len(calls) == 4:
            raise RuntimeError("stopped")
        return once(*args)

    with monkeypatch.context() as broken:
        broken.setattr(Q, "append_once", dies)
        with pytest.raises(Exception, match="stopped"):
            stream()
    for _ in range(2):
        stream()
        assert [spark.table(t).count() for t in tables] == [4, 10]
