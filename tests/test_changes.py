from __future__ import annotations

import random
from collections import Counter

import pytest

from continuity.operators import changes as C
from continuity.operators.joins import JoinLimits
from tests.helpers import plan, rows

DDL = "k int, `a b` string, v array<int>"
SALTED = JoinLimits(broadcast_rows=0, broadcast_bytes=0, hot_rows=5, hot_share=10)


def versions(seed):
    """Two versions with keys that repeat, null keys and copies of rows."""
    rng = random.Random(seed)

    def row():
        key = rng.choice([None, *range(30)])
        return (key, rng.choice(["x", "y", None]), rng.choice([None, (1,), (2, 3)]))

    before = [row() for _ in range(200)]
    after = [r for r in before if rng.random() < 0.8] + [row() for _ in range(40)]
    return before, after


def frame(spark, rows_):
    return spark.createDataFrame([(k, a, None if v is None else list(v)) for k, a, v in rows_], DDL)


def plain(df):
    return Counter((r.k, r["a b"], None if r.v is None else tuple(r.v)) for r in df.collect())


def brute(before, after):
    b, a = Counter(before), Counter(after)
    went, came = b - a, a - b
    lost, gained = {r[0] for r in went}, {r[0] for r in came}
    want = Counter()
    for r, n in went.items():
        want[(r, "update_before" if r[0] in gained else "delete", n)] += 1
    for r, n in came.items():
        want[(r, "update_after" if r[0] in lost else "insert", n)] += 1
    return want


@pytest.mark.parametrize("limits", [JoinLimits(), SALTED], ids=["auto", "salted"])
def test_changes_equal_brute_force_and_lead_from_one_version_to_the_next(spark, limits):
    before, after = versions(3)
    b, a = frame(spark, before), frame(spark, after)
    changes = C.row_changes(b, a, ["k"], limits=limits)
    got = Counter(
        ((r.k, r["a b"], None if r.v is None else tuple(r.v)), r.change, r.copies)
        for r in changes.collect()
    )
    assert got == brute(before, after)
    assert any(n > 1 for (_, _, n) in got) and len({c for _, c, _ in got}) > 1
    assert plain(C.apply_changes(b, changes, limits)) == Counter(after)
    assert C.conflicts(b, changes, limits).count() == 0
    counted = {r.change: (r.n_rows, r.n_copies) for r in C.change_counts(changes).collect()}
    assert sum(n for n, _ in counted.values()) == len(got)
    assert "CartesianProduct" not in plan(changes)


def test_a_third_copy_keeps_its_own_rows_and_conflicts_are_told(spark):
    before = [(1, "x", None), (1, "x", None), (2, "y", None), (3, "z", None)]
    after = [(1, "x", None), (2, "new", None), (4, "w", None)]
    third = [(1, "x", None)] * 3 + [(3, "z", None), (9, "own", None)]
    changes = C.row_changes(frame(spark, before), frame(spark, after), ["k"])
    moved = C.apply_changes(frame(spark, third), changes)
    assert plain(moved) == Counter(
        [(1, "x", None)] * 2 + [(2, "new", None), (4, "w", None), (9, "own", None)]
    )
    lacking = C.conflicts(frame(spark, third), changes)
    assert [(r.k, r["a b"], r.copies, r.n_held) for r in lacking.collect()] == [(2, "y", 1, 0)]


def test_equal_and_empty_versions_and_clashing_names(spark):
    some, none = frame(spark, [(1, "x", None)] * 2), frame(spark, [])
    assert C.row_changes(some, some, ["k"]).count() == 0
    assert rows(C.change_counts(C.row_changes(none, some, ["k"]))) == {("insert", 1, 2): 1}
    emptied = C.row_changes(some, none, ["k", "a b"])
    assert plain(C.apply_changes(some, emptied)) == Counter()
    with pytest.raises(ValueError, match="change"):
        C.row_changes(some.withColumnRenamed("a b", "Change"), some, ["k"])
    with pytest.raises(ValueError, match="no key"):
        C.row_changes(some, some, ["absent"])
