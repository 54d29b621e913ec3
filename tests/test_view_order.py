from __future__ import annotations

import random

import pytest

from continuity.plans import views as V
from continuity.plans.status import StatusLog
from continuity.schemas import TABLES_DDL
from continuity.workspace import run_database

RELATIONS = {
    "SELECT a FROM `x y`.b JOIN c USING (i) WHERE i IN (SELECT i FROM D.E.f) AND EXISTS (SELECT 1 FROM g)":
        {("x y", "b"), ("c",), ("d", "e", "f"), ("g",)},
    "WITH t AS (SELECT * FROM h), u AS (SELECT * FROM t JOIN i) SELECT *, (SELECT max(k) FROM j) FROM u, k2, t":
        {("h",), ("i",), ("j",), ("k2",)},
    # The subquery reads the table it is named after, and a later one may not be meant yet.
    "WITH t AS (SELECT * FROM t) SELECT * FROM t": {("t",)},
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a, b": {("b",)},
    "SELECT * FROM (WITH q AS (SELECT 1) SELECT * FROM q) JOIN q": {("q",)},
    "SELECT * FROM VALUES (1) AS v(a) UNION SELECT a FROM (SELECT a FROM l) z": {("l",)},
    "TABLE m": {("m",)},
    "SELECT 'FROM x' AS s, range.id FROM range(3)": set(),
    "SELEC 1": set(),
}


@pytest.mark.parametrize("definition", RELATIONS)
def test_relations(spark, definition):
    assert V.relations_of(spark, definition) == RELATIONS[definition]


def literal_levels(names, reads):
    """By walking from every node."""

    def cyclic(start):
        seen, todo = set(), list(reads[start])
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += reads[at]
        return start in seen

    loops = {n for n in names if cyclic(n)}
    levels = {}

    def level(n):
        if n not in levels:
            levels[n] = None if n in loops else 0
            below = [] if n in loops else [level(m) for m in reads[n]]
            if None in below:
                levels[n] = None
            elif below:
                levels[n] = 1 + max(below)
        return levels[n]

    return {n: (level(n), n in loops) for n in names}


def test_levels_of_graphs(spark):
    rng = random.Random(4)
    names, reads = [], {}
    for graph in range(6):
        size = 12
        own = [f"g{graph}_{k}" for k in range(size)]
        names += own
        for k, name in enumerate(own):
            # Even graphs have no cycle; one is a chain, one has a loop on itself.
            below = own[:k] if graph % 2 == 0 else own
            reads[name] = {own[k - 1]} if graph == 4 and k else set(rng.sample(below, min(len(below), rng.randint(0, 2))))
    reads["g1_0"] = {"g1_0"}
    edges = spark.createDataFrame([(n, m) for n in names for m in reads[n]], "name string, reads string")
    nodes = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.level, r.in_cycle) for r in V.dependency_levels(edges, nodes).collect()}
    assert got == literal_levels(names, reads)
    assert max(level for level, _ in got.values() if level is not None) == 11


def test_a_chain_and_a_cycle_in_one_attempt_each(spark, monkeypatch):
    db = run_database(spark, "chain")
    spark.range(100).write.saveAsTable(f"{db}.base")
    definitions = {"v0": "SELECT * FROM base"}
    definitions |= {f"v{k}": f"SELECT * FROM {db}.V{k - 1} WHERE id >= {k}" for k in range(1, 50)}
    definitions |= {"a": "SELECT * FROM b", "b": "SELECT * FROM c", "c": "SELECT * FROM a JOIN v1", "on_a": "SELECT * FROM a", "self": "SELECT * FROM self", "broken": "SELECT * FROM absent"}
    rows = [("c", "s", n, "VIEW", None, None, text, "me") for n, text in definitions.items()]
    random.Random(2).shuffle(rows)
    tried = []
    made = V.create_view
    monkeypatch.setattr(V, "create_view", lambda *args: (tried.append(args[1]), made(*args)))
    log = StatusLog(spark)
    plan = V.view_plan(spark.createDataFrame(rows, TABLES_DDL))
    V.create_views(spark, plan, log, lambda r: f"`{db}`.`{r.view}`", database_of=lambda r: f"`{db}`")
    status = {r.table: r.status for r in log.frame().collect()}
    assert len(tried) == len(set(tried)) == 51
    assert all(status[f"v{k}"] == "SUCCESS" for k in range(50))
    assert {status[n] for n in ("a", "b", "c", "self")} == {"FAIL: views that depend on each other"}
    assert status["on_a"] == "FAIL: reads views that depend on each other"
    assert "absent" in status["broken"] and len(status) == len(definitions)
    assert spark.table(f"{db}.v49").count() == 51
