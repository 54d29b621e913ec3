"""Rebuild views on the target from their stored definitions."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from continuity.functions.digest import same_digest
from continuity.functions.names import qualified_name
from continuity.operators.listing import user_tables
from continuity.plans.status import SUCCESS, Status, StatusLog, failure, record
from continuity.threads import run_each
from continuity.workspace import run_folder, stored


def view_plan(tables: DataFrame) -> DataFrame:
    """One row per view to create."""
    return user_tables(tables, "VIEW").select(
        "catalog",
        "schema",
        F.col("name").alias("view"),
        qualified_name("catalog", "schema", "name").alias("target"),
        "view_definition",
    )


def create_view(
    spark: SparkSession, target: str, definition: str, database: str | None = None
) -> None:
    """``database``: where names without one are looked up, the view's own namespace. The view
    is made in a session of its own, so other threads keep their current database."""
    session = spark
    if database is not None:
        session = spark.newSession()
        session.sql(f"USE {database}")
    session.sql(f"CREATE OR REPLACE VIEW {target} AS {definition}")


# A relation and a list of named subqueries, as Spark prints them in a plan that was only parsed.
_RELATION = re.compile(r"'UnresolvedRelation \[(.*)\], \[.*\], (?:true|false)$")
_WITH = re.compile(r"CTE \[(.*)\]$")
_INDENT = re.compile(r"[ :+\-|]*")


def relations_of(spark: SparkSession, definition: str) -> set[tuple[str, ...]]:
    """Names that a query reads, each as its parts, in lower case; empty if it cannot be parsed.

    They are taken from Spark's own parsed plan, subqueries included. A name given to a subquery
    by ``WITH`` counts only where it is not that subquery that is meant.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(definition)
    except Exception:
        return set()
    # One list of children per open node, by how far the node stands in.
    root: list[tuple[str, list]] = []
    open_nodes = [(-1, root)]
    for line in plan.treeString().splitlines():
        indent = _INDENT.match(line).end()
        node = (line[indent:].rstrip(), [])
        while open_nodes[-1][0] >= indent:
            open_nodes.pop()
        open_nodes[-1][1].append(node)
        open_nodes.append((indent, node[1]))
    found: set[tuple[str, ...]] = set()
    _read(root, frozenset(), found)
    return found


def _read(nodes: list[tuple[str, list]], named: frozenset[str], found: set[tuple[str, ...]]) -> None:
    for text, below in nodes:
        relation, subqueries = _RELATION.match(text), _WITH.match(text)
        if relation:
            parts = tuple(part.lower() for part in relation[1].split(", "))
            if len(parts) > 1 or parts[0] not in named:
                found.add(parts)
        if not subqueries:
            _read(below, named, found)
            continue
        # Each subquery sees those before it, the query sees all.
        inside = named
        names = subqueries[1].lower().split(", ")
        for name, subquery in zip(names, below):
            _read([subquery], inside, found)
            inside = inside | {name}
        _read(below[len(names) :], inside, found)


def _full_name(parts: tuple[str, ...], database: str | None) -> str:
    """A name as database and table; the session catalog need not be named."""
    if len(parts) == 1 and database:
        parts = (database.strip("`").lower(), *parts)
    if len(parts) == 3 and parts[0] == "spark_catalog":
        parts = parts[1:]
    return ".".join(parts)


def view_edges(
    spark: SparkSession,
    plan: DataFrame,
    target_of: Callable[[Row], str],
    definition_of: Callable[[Row], str],
    database_of: Callable[[Row], str] | None = None,
    batch: int = 1000,
) -> DataFrame:
    """(view, reads, row): every view of a plan under the name it will have, with the views of the
    plan that it reads. Definitions are parsed on the driver, some at a time."""
    folder = run_folder(spark, "view_edges")
    ddl = f"name string, reads array<string>, row struct<{_row_ddl(plan)}>"
    spark.createDataFrame([], ddl).write.parquet(folder)
    rows = iter(plan.toLocalIterator())
    while chunk := list(islice(rows, batch)):
        made = []
        for row in chunk:
            database = database_of(row) if database_of else None
            reads = {_full_name(r, database) for r in relations_of(spark, definition_of(row))}
            name = target_of(row).replace("`", "").lower()
            made.append((_full_name(tuple(name.split(".")), database), sorted(reads), row))
        spark.createDataFrame(made, ddl).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(ddl).parquet(folder)


def _row_ddl(plan: DataFrame) -> str:
    return plan._jdf.schema().toDDL()


def dependency_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, level, in_cycle) for every node (name). ``edges`` has (name, reads), both nodes.

    Level 0 reads no other node, every other one is one above the highest it reads. Nodes on a
    cycle, or that read one, have no level. Paths are found by doubling their length, so the
    number of joins grows with the logarithm of the longest chain.
    """
    edges = stored(edges.select("name", "reads").distinct(), "view_edges")
    reach = edges
    while True:
        further = reach.alias("a").join(
            reach.alias("b"), F.col("a.reads") == F.col("b.name")
        ).select("a.name", "b.reads")
        grown = stored(reach.unionByName(further).distinct(), "view_reach")
        if grown.count() == reach.count():
            break
        reach = grown
    cyclic = reach.filter("name = reads").select("name", F.lit(True).alias("in_cycle"))
    stuck = cyclic.select("name").union(
        reach.join(cyclic.select(F.col("name").alias("reads")), "reads", "left_semi").select("name")
    ).distinct()
    stuck = stored(stuck, "view_stuck")
    paths = edges.join(stuck, "name", "left_anti").withColumn("length", F.lit(1))
    paths = stored(paths, "view_paths")
    while True:
        further = paths.alias("a").join(
            paths.alias("b"), F.col("a.reads") == F.col("b.name")
        ).select("a.name", "b.reads", (F.col("a.length") + F.col("b.length")).alias("length"))
        grown = stored(
            paths.unionByName(further).groupBy("name", "reads").agg(F.max("length").alias("length")),
            "view_paths",
        )
        if grown.agg(F.sum("length")).first()[0] == paths.agg(F.sum("length")).first()[0]:
            break
        paths = grown
    longest = paths.groupBy("name").agg(F.max("length").alias("longest"))
    return (
        nodes.select("name")
        .join(longest, "name", "left")
        .join(cyclic, "name", "left")
        .join(stuck.withColumn("stuck", F.lit(True)), "name", "left")
        .select(
            "name",
            F.when(F.col("stuck").isNull(), F.coalesce("longest", F.lit(0))).alias("level"),
            F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
        )
    )


def view_levels(planned: DataFrame) -> DataFrame:
    """``view_edges`` rows (name, row) with ``level`` and ``problem``: what is wrong with views
    that depend on each other, or on such views."""
    names = planned.select("name").distinct()
    edges = (
        planned.select("name", F.explode("reads").alias("reads"))
        .join(names.withColumnRenamed("name", "reads"), "reads", "left_semi")
    )
    levels = dependency_levels(edges, names)
    problem = F.when(F.col("in_cycle"), "views that depend on each other").when(
        F.col("level").isNull(), "reads views that depend on each other"
    )
    return planned.join(levels, "name").select("name", "row", "level", problem.alias("problem"))


def create_views(
    spark: SparkSession,
    plan: DataFrame,
    log: StatusLog,
    target_of: Callable[[Row], str],
    definition_of: Callable[[Row], str] = lambda row: row.view_definition,
    workers: int = 8,
    database_of: Callable[[Row], str] | None = None,
) -> None:
    """Create every view of a plan, those that others read first, each in one attempt.

    Views are taken level by level (``view_levels``), those of one level several at a time. Views
    that depend on each other become a status row and nothing else.
    """

    def create(row: Row) -> Status:
        log.begin(record(row.catalog, row.schema, row.view, "view", None))
        try:
            database = database_of(row) if database_of else None
            create_view(spark, target_of(row), definition_of(row), database)
            status = SUCCESS
        except Exception as error:
            status = failure(error)
        return record(row.catalog, row.schema, row.view, "view", status)

    waiting = log.remaining(plan, "view", "view")
    planned = view_edges(spark, waiting, target_of, definition_of, database_of)
    levelled = stored(view_levels(planned), "view_levels")
    for stuck in levelled.filter("problem IS NOT NULL").toLocalIterator():
        row = stuck.row
        log.add(record(row.catalog, row.schema, row.view, "view", failure(stuck.problem)))
    # One entry per level.
    for level in sorted(r.level for r in levelled.filter("problem IS NULL").select("level").distinct().collect()):
        rows = (r.row for r in levelled.filter(F.col("level") == level).toLocalIterator())
        for status in run_each(create, rows, workers):
            log.add(status)


def same_view(spark: SparkSession, source: str, target: str) -> bool:
    """Whether a view and its replica give the same rows, compared as multisets."""
    return same_digest(spark.table(source), spark.table(target))
