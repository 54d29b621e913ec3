from __future__ import annotations

import hashlib
import random
import re

import pytest

from continuity.llm import infill
from continuity.llm.queries import op11_fill_in_middle
from tests.llm import cases

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def literal(key, text):
    """The rule, word for word: units as a list, pieces by slicing it."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = (
        "".join(part) for part in (units[:low], units[low:high], units[high:])
    )
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_places_for_every_cut_and_block_size():
    rng = random.Random(1)
    alphabet = "ab Z9\n\x00é漢🙂<PSM>"
    for block in (1, 2, 3, 5, 8, 64):
        for length in (0, 1, 2, 7, 40, 130):
            text = "".join(rng.choice(alphabet) for _ in range(length))
            units, at = UNIT.findall(text), 0
            tree = infill.BlockTree(text, block)
            assert (tree.units, tree.chars) == (len(units), len(text))
            for k, unit in enumerate(units):
                assert tree.place(k) == at
                at += len(unit)
            assert tree.place(len(units)) == len(text)


def test_texts_over_many_slices():
    text = ("word " * 3 + "é漢" + "x" * 5000 + "\n") * 400
    units = UNIT.findall(text)
    tree = infill.BlockTree(text)
    assert len(tree.tree) > 4 * 256 and tree.units == len(units)
    for k in (0, 1, len(units) // 3, len(units) - 1):
        assert tree.place(k) == sum(map(len, units[:k]))


def test_rows_are_those_of_the_rule(spark):
    extra = ["<P", ">", "a<P>b", "<S<S", "ends with <", "<M", "x<", "S>y"]
    rows = list(enumerate(cases.texts())) + [(k + 100, t) for k, t in enumerate(extra * 6)]
    rows += [(None, "null id here"), (None, None), rows[6], rows[6], (-5, cases.prose(3, 90))]
    rows += [(1000 + k, cases.prose(k, 30) + "é🙂") for k in range(200)]
    df = cases.documents(spark, rows)
    made = infill.fill_in_middle(df, block=64, keep=("doc_id", "text", "spans", "copies"))
    made = made.withColumn("again", infill.restored())
    assert {r.spans for r in made.collect()} == {"clash"}
    got = sorted(
        (
            (r.doc_id, r.text or "", r.n, r.form, r.prefix_chars, r.middle_chars, r.output)
            for r in made.collect()
        ),
        key=repr,
    )
    expected = sorted(((k, t or "", *literal(k, t)) for k, t in rows), key=repr)
    assert got == expected
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert all(r.again == (r.text or "") for r in made.collect())


def test_taken_names_are_refused(spark):
    with pytest.raises(ValueError, match="form"):
        infill.fill_in_middle(cases.documents(spark), keep=("Form",))


def test_query_on_cases_and_empty_tables(spark, tmp_path):
    cases.documents(spark).write.parquet(str(tmp_path / "some" / "documents.parquet"))
    assert op11_fill_in_middle(spark, str(tmp_path / "some")).count() == cases.documents(spark).count()
    cases.no_documents(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert op11_fill_in_middle(spark, str(tmp_path / "none")).count() == 0
