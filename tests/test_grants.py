from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from continuity.operators import grants as G
from continuity.operators.joins import JoinLimits
from continuity.operators.listing import securables
from continuity.schemas import GRANTS_DDL
from tests.helpers import plan, rows

SECURABLES = "securable_type string, full_name string"
SALTED = JoinLimits(broadcast_rows=0, broadcast_bytes=0, hot_rows=5, hot_share=10)


def grants(spark, *cells):
    return spark.createDataFrame([("TABLE", *c) for c in cells], GRANTS_DDL)


def objects(spark, *names):
    return spark.createDataFrame([("TABLE", n) for n in names], SECURABLES)


@pytest.fixture(scope="module")
def sides(spark):
    source = grants(
        spark,
        ("t1", "only_source", "SELECT"),
        ("t1", "both", "SELECT"),
        ("t1", "both", "MODIFY"),
        ("t1", "equal", "SELECT"),
        ("t1", "equal", "SELECT"),
        ("t1", "nothing", None),
        ("t2", "equal", "SELECT"),
        ("gone", "x", "SELECT"),
    )
    target = grants(
        spark,
        ("t1", "only_target", "SELECT"),
        ("t1", "both", "SELECT"),
        ("t1", "both", "DROP"),
        ("t1", "equal", "SELECT"),
        ("t1", "nothing", None),
        ("t2", "equal", "SELECT"),
        ("extra", "y", "SELECT"),
    )
    return source, target, (objects(spark, "t1", "t2", "gone"), objects(spark, "t1", "t2", "extra"))


@pytest.mark.parametrize("limits", [JoinLimits(), SALTED], ids=["auto", "salted"])
def test_diff_and_changes(sides, limits):
    source, target, both = sides
    diff = G.grant_diff(source, target, both, limits)
    assert diff.filter("full_name in ('gone', 'extra')").count() == 0
    changes = {
        r.principal: (r.add, r.remove, r.change_kind) for r in G.grant_changes(diff).collect()
    }
    assert changes == {
        "only_source": (["SELECT"], [], "add"),
        "only_target": ([], ["SELECT"], "remove"),
        "both": (["MODIFY"], ["DROP"], "both"),
    }
    assert G.grant_adds(diff).count() == 2 and G.grant_removes(diff).count() == 2
    assert "CartesianProduct" not in plan(diff)


def test_status_and_not_found(sides):
    source, target, both = sides
    expected = {"t1": "SUCCESS", "t2": None, "gone": "NotFound"}
    for diff in (G.grant_diff(source, target, both), G.grant_diff(source, target)):
        assert {r.full_name: r.status for r in G.grant_status(diff, *both).collect()} == expected
    assert [r.full_name for r in G.not_found(*both).collect()] == ["gone"]


def test_principals_count_without_privileges(sides):
    source, target, both = sides
    got = {(r.full_name, r.principal) for r in G.grant_principals(source, target, both).collect()}
    names = ("only_source", "only_target", "both", "equal", "nothing")
    assert got == {("t1", n) for n in names} | {("t2", "equal")}


def test_diff_of_equal_sides_changes_nothing(sides):
    source, _, _ = sides
    assert G.grant_diff(source, source).filter("change != 'same'").count() == 0


@pytest.mark.parametrize("limits", [JoinLimits(), SALTED], ids=["auto", "salted"])
@pytest.mark.parametrize("seed", [1, 2])
def test_convergence_against_brute_force(spark, seed, limits):
    rand = random.Random(seed)

    def side():
        cells = []
        for _ in range(400):
            # One object holds a third of the grants.
            name = "hot" if rand.random() < 1 / 3 else f"t{rand.randrange(20)}"
            cells.append((name, f"u{rand.randrange(30)}", rand.choice(["A", "B", "C", None])))
        return cells

    ours, theirs = side(), side()
    source_names = {"hot", *(f"t{i}" for i in range(15))}
    target_names = {"hot", *(f"t{i}" for i in range(5, 20))}
    both = objects(spark, *sorted(source_names)), objects(spark, *sorted(target_names))
    source, target = grants(spark, *ours), grants(spark, *theirs)
    after = G.grants_after(source, target, both, limits)
    common = source_names & target_names

    def held(cells):
        found = defaultdict(set)
        for name, principal, privilege in cells:
            if privilege is not None:
                found[name].add((principal, privilege))
        return found

    want, had = held(ours), held(theirs)
    expected = {
        (n, *g) for n in {*want, *had} for g in (want if n in common else had).get(n, ())
    }
    assert rows(after.drop("securable_type")) == {e: 1 for e in expected}
    # A second comparison finds nothing to do on common objects.
    again = G.grant_diff(source, after, both, limits)
    assert again.filter("change != 'same'").count() == 0
    adds = {tuple(r)[1:] for r in G.grant_adds(G.grant_diff(source, target, both, limits)).collect()}
    assert adds == {(n, *g) for n in common for g in want[n] - had[n]}


@pytest.mark.parametrize("limits", [JoinLimits(), SALTED], ids=["auto", "salted"])
def test_effective_grants(spark, limits):
    catalogs = spark.createDataFrame([("c",), ("d",)], "catalog string")
    schemas = spark.createDataFrame([("c", "s"), ("c", "r"), ("d", "s")], "catalog string, schema string")
    named = "catalog string, schema string, name string"
    tables = spark.createDataFrame(
        [("c", "s", "t"), ("c", "r", "t"), ("d", "s", "t"), ("d", "information_schema", "x")], named
    )
    volumes = spark.createDataFrame([("c", "s", "v")], named)
    every = securables(catalogs, schemas, tables, volumes)
    assert [r.securable_type for r in every.select("securable_type").distinct().orderBy("securable_type").collect()] == [
        "CATALOG", "SCHEMA", "TABLE", "VOLUME",
    ]
    direct = spark.createDataFrame(
        [
            ("CATALOG", "c", "admin", "ALL"),
            ("CATALOG", "c", "admin", "ALL"),
            ("SCHEMA", "c.s", "team", "USE"),
            ("SCHEMA", "c.s", "admin", "ALL"),
            ("TABLE", "c.s.t", "bob", "SELECT"),
            ("TABLE", "c.s.t", "team", "USE"),
            ("TABLE", "c.s.t", "nobody", None),
            ("TABLE", "c.s.unknown", "bob", "SELECT"),
            ("VOLUME", "c.s.v", "bob", "READ"),
        ],
        GRANTS_DDL,
    )
    got = rows(G.effective_grants(every, direct, limits))
    assert got == {
        e: 1
        for e in [
            ("CATALOG", "c", "admin", "ALL"),
            ("SCHEMA", "c.s", "admin", "ALL"),
            ("SCHEMA", "c.s", "team", "USE"),
            ("SCHEMA", "c.r", "admin", "ALL"),
            ("TABLE", "c.s.t", "admin", "ALL"),
            ("TABLE", "c.s.t", "team", "USE"),
            ("TABLE", "c.s.t", "bob", "SELECT"),
            ("TABLE", "c.r.t", "admin", "ALL"),
            ("VOLUME", "c.s.v", "admin", "ALL"),
            ("VOLUME", "c.s.v", "team", "USE"),
            ("VOLUME", "c.s.v", "bob", "READ"),
        ]
    }


def _closure(objects, direct):
    """Effective grants of a set of securables, by looking up."""
    found = set()
    for kind, name in objects:
        parts = name.split(".")
        above = [("CATALOG", parts[0])] + ([("SCHEMA", ".".join(parts[:2]))] if len(parts) > 2 else [])
        if (kind, name) in direct or (kind != "CATALOG" and any(a in direct for a in above)):
            found.add((kind, name))
    return frozenset(found)


@pytest.mark.parametrize(
    ("limits", "unlisted"),
    [(JoinLimits(), set()), (SALTED, {("SCHEMA", "c.s")}), (JoinLimits(), {("CATALOG", "c")})],
    ids=["auto", "salted, schema not listed", "catalog not listed"],
)
def test_least_grants_are_the_smallest(spark, limits, unlisted):
    """Against every subset of a small tree: wanted sets of any kind, one per principal."""
    tree = [
        ("CATALOG", "c"), ("CATALOG", "d"), ("SCHEMA", "c.s"), ("SCHEMA", "c.r"), ("SCHEMA", "c.empty"),
        ("TABLE", "c.s.t"), ("VOLUME", "c.s.v"), ("TABLE", "c.r.t"),
    ]
    objects = [o for o in tree if o not in unlisted]
    listed = spark.createDataFrame(
        [(k, n, n.split(".")[0], n.split(".")[1] if "." in n else None) for k, n in objects] * 2,
        SECURABLES + ", catalog string, schema string",
    )
    subsets = [
        frozenset(o for i, o in enumerate(objects) if bits >> i & 1) for bits in range(1 << len(objects))
    ]
    closed = {s: _closure(objects, s) for s in subsets}
    rng = random.Random(7)
    wanted = rng.sample(subsets, 20) + [closed[s] for s in rng.sample(subsets, 20)] + [subsets[-1]]
    who = [None if i == 0 else f"p{i}" for i in range(len(wanted))]
    cells = [(*o, p, "USE") for p, w in zip(who, wanted, strict=True) for o in w] * 2
    cells += [("TABLE", "c.s.unknown", "p1", "USE"), ("TABLE", "c.s.t", "p1", None)]
    given = spark.createDataFrame(cells, GRANTS_DDL)
    placed = G.grant_placement(listed, given, limits).collect()
    least = defaultdict(set)
    for r in G.least_grants(listed, given, limits).collect():
        least[r.principal].add((r.securable_type, r.full_name))
    for p, w in zip(who, wanted, strict=True):
        safe = [s for s in subsets if closed[s] <= w]
        most = max((closed[s] for s in safe), key=len)
        smallest = min(len(s) for s in safe if closed[s] == most)
        assert closed[frozenset(least[p])] == most and len(least[p]) == smallest
        mine = {(r.securable_type, r.full_name): r for r in placed if r.principal == p}
        assert set(mine) == set(w)
        assert {o for o, r in mine.items() if r.placement == G.REFUSED} == w - most
        assert {o for o, r in mine.items() if r.placement == G.DIRECT} == least[p]
        for o, r in mine.items():
            below = closed[frozenset([o])]
            assert r.n_surplus == len(below - w)


def test_least_grants_undo_the_closure(spark):
    listed = spark.createDataFrame(
        [("CATALOG", "c", "c", None), ("SCHEMA", "c.s", "c", "s"), ("TABLE", "c.s.t", "c", "s")],
        SECURABLES + ", catalog string, schema string",
    )
    direct = spark.createDataFrame(
        [("CATALOG", "c", "admin", "ALL"), ("TABLE", "c.s.t", "admin", "ALL"), ("TABLE", "c.s.t", "bob", "SELECT")],
        GRANTS_DDL,
    )
    full = G.effective_grants(listed, direct)
    least = G.least_grants(listed, full)
    assert rows(least) == {("CATALOG", "c", "admin", "ALL"): 1, ("TABLE", "c.s.t", "bob", "SELECT"): 1}
    assert rows(G.effective_grants(listed, least)) == rows(full)
    assert G.least_grants(listed, full.limit(0)).count() == 0
    assert "CartesianProduct" not in plan(least) and "BatchEvalPython" not in plan(least)


def test_wanted_grants_are_made_once(spark):
    """Although the join with the securables looks for hot keys first."""
    listed = spark.createDataFrame(
        [("CATALOG", "c", "c", None), ("SCHEMA", "c.s", "c", "s")]
        + [("TABLE", f"c.s.t{i}", "c", "s") for i in range(200)],
        SECURABLES + ", catalog string, schema string",
    )
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        made.add(1)
        return name

    wanted = listed.filter("full_name != 'c'").select(
        "securable_type", counted.asNondeterministic()("full_name").alias("full_name"),
        F.lit("p").alias("principal"), F.lit("USE").alias("privilege"),
    )
    least = G.least_grants(listed, wanted, SALTED)
    assert made.value == 201
    assert rows(least) == {("SCHEMA", "c.s", "p", "USE"): 1}
