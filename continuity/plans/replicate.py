"""Copy tables as verified snapshots.

A copy is written to a new version folder, read back and compared with what was read from
the source, and only then published under the target's name. Readers see the old version
until then; a copy that fails leaves it in place. A partitioned copy that is asked to skip what
did not change moves only the partitions that did (``partitions``).
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from continuity.functions.digest import digest, digest_aggregates, normal
from continuity.functions.names import quote, text_literal
from continuity.plans.clone import BY_NAME, BY_PATH
from continuity.plans.partitions import (
    GONE,
    SAME,
    add_partitions,
    compare_parts,
    rows_of_parts,
    source_parts,
    written_parts,
)
from continuity.plans.status import SUCCESS, Status, StatusLog, failure, record
from continuity.sources.inventory import describe_table
from continuity.sources.tables import path_partitions, read_named, read_path
from continuity.threads import run_each
from continuity.workspace import run_id, stored

# Table properties of a published copy: the kind of its source, its source's files, and where
# the index of its partitions is, and the journaled run that made it.
KIND = "continuity.kind"
FILES = "continuity.source_files"
INDEX = "continuity.partition_index"
RUN = "continuity.run"
# Formats whose own catalog replaces a table in one step.
ATOMIC_FORMATS = ("delta", "iceberg")
# Formats a copy keeps; tables of any other format (text files) are copied to Parquet.
KEPT_FORMATS = ("parquet", "orc", *ATOMIC_FORMATS)


@dataclass(frozen=True)
class TableFacts:
    """What a copy has to carry over besides the rows."""

    partition_by: tuple[str, ...] = ()
    comment: str | None = None
    properties: Mapping[str, str] = field(default_factory=dict)
    kind: str = "EXTERNAL"
    location: str | None = None
    provider: str | None = None
    files: str | None = None
    index: str | None = None
    run: str | None = None


@dataclass(frozen=True)
class Copied:
    """What one copy moved. Counts of partitions are zero for a table without a layout."""

    rows: int = 0
    written: int = 0
    kept: int = 0
    dropped: int = 0


def table_facts(spark: SparkSession, identifier: str) -> TableFacts:
    facts = describe_table(spark, identifier)
    properties = facts.get("table_properties") or {}
    return TableFacts(
        partition_by=tuple(facts.get("partition_columns") or ()),
        comment=facts.get("comment"),
        properties={k: v for k, v in properties.items() if not k.startswith("continuity.")},
        kind=properties.get(KIND, facts["type"]),
        location=facts.get("location"),
        provider=facts.get("provider"),
    )


def copy_format(fmt: str | None, source_format: str | None) -> str:
    """The format asked for, else the source's own where a copy can keep it."""
    if fmt:
        return fmt
    own = (source_format or "").lower()
    return own if own in KEPT_FORMATS else "parquet"


def source_files(df: DataFrame) -> str | None:
    """Digest of the files ``df`` reads: path, size and time of change of each; null for a
    source that is no plain scan of files.

    Only the hidden metadata column is asked for, so a columnar source answers from its
    footers, and files are told apart on the map side.
    """
    columns = ("file_path", "file_size", "file_modification_time")
    try:
        files = df.select(*[f"_metadata.{column}" for column in columns])
    except AnalysisException:
        return None
    return json.dumps(digest(files.distinct()))


def _write(df: DataFrame, version: str, fmt: str, partition_by: Sequence[str]) -> dict[str, int]:
    """Write ``df`` to a folder and return the digest of its rows, taken while they are written,
    so the source is read once.

    There is no shuffle: a partitioned source is scanned in files of one partition value each,
    so its tasks write few partitions.
    """
    seen = Observation(f"copy_{run_id()}")
    df.observe(seen, *digest_aggregates(df)).write.format(fmt).partitionBy(*partition_by).save(
        version
    )
    return normal(seen.get)


def _written(df: DataFrame, version: str, fmt: str) -> DataFrame:
    return df.sparkSession.read.format(fmt).schema(df.schema).load(version)


def _check(df: DataFrame, version: str, written: dict[str, int], seen: dict[str, int]) -> None:
    # Counters of a task that ran twice may be off; then ask the source itself.
    if written != seen and written != digest(df):
        raise RuntimeError(f"copy in {version} differs from its source")


def write_version(
    df: DataFrame, folder: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> tuple[str, int]:
    """Write ``df`` to a new version folder below ``folder`` and verify it. Returns the folder
    and the number of rows."""
    version = f"{folder.rstrip('/')}/v_{run_id()}"
    seen = _write(df, version, fmt, partition_by)
    written = digest(_written(df, version, fmt).select(*df.columns))
    _check(df, version, written, seen)
    return version, written["rows"]


def write_partitions(
    df: DataFrame, folder: str, fmt: str, layout: Sequence[str]
) -> tuple[str, DataFrame]:
    """Like ``write_version``, with the rows (part, content, folder) of the partitions written:
    the copy is read back once, by partition, and their digests add up to that of the whole."""
    version = f"{folder.rstrip('/')}/v_{run_id()}"
    seen = _write(df, version, fmt, layout)
    parts = stored(written_parts(_written(df, version, fmt), layout, df.columns), "partitions")
    total = parts.select("content.*").agg(*[F.sum(c).alias(c) for c in seen]).first()
    _check(df, version, normal(total.asDict()), seen)
    return version, parts


def clustered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Gather rows by partition value before a write in a new layout. Large values are split
    over several tasks and small ones share one (needs adaptive execution)."""
    return df.hint("rebalance", *partition_by) if partition_by else df


def _table_exists(spark: SparkSession, target: str) -> bool:
    return spark.catalog.tableExists(target)


def _columns_ddl(df: DataFrame) -> str:
    return df._jdf.schema().toDDL()


def publish(
    spark: SparkSession,
    df: DataFrame,
    target: str,
    version: str,
    fmt: str,
    facts: TableFacts,
    index: DataFrame | None = None,
) -> None:
    """Point ``target`` at a verified version folder, or at the partitions of an index.

    An unpartitioned copy with the same columns is switched in place, in one step. Otherwise
    a complete new entry is made next to the old one and takes its name: partitions of two
    versions are never mixed. Anything else of that name is replaced, except a view.
    """
    if not _table_exists(spark, target):
        _create(spark, df, target, version, fmt, facts, index)
        return
    existing = describe_table(spark, target)
    if existing["type"] == "VIEW":
        raise RuntimeError(f"{target} is a view and is not replaced by a table")
    same = (
        KIND in (existing.get("table_properties") or {})
        and not facts.partition_by
        and not existing.get("partition_columns")
        and spark.table(target).schema.simpleString() == df.schema.simpleString()
        and existing.get("provider") == fmt
    )
    if same:
        comment = text_literal(facts.comment) if facts.comment else "NULL"
        spark.sql(f"ALTER TABLE {target} SET LOCATION {text_literal(version)}")
        spark.sql(f"ALTER TABLE {target} SET TBLPROPERTIES ({_properties(facts)})")
        surplus = [
            k
            for k in existing.get("table_properties") or {}
            if k not in facts.properties and not k.startswith("continuity.")
        ]
        if surplus:
            names = ", ".join(text_literal(k) for k in surplus)
            spark.sql(f"ALTER TABLE {target} UNSET TBLPROPERTIES IF EXISTS ({names})")
        if (existing.get("comment") or None) != (facts.comment or None):
            spark.sql(f"COMMENT ON TABLE {target} IS {comment}")
        spark.catalog.refreshTable(target)
        return
    run = run_id()
    new, old = _beside(target, f"__new_{run}"), _beside(target, f"__old_{run}")
    _create(spark, df, new, version, fmt, facts, index)
    spark.sql(f"ALTER TABLE {target} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {new} RENAME TO {target}")
    except Exception:
        spark.sql(f"ALTER TABLE {old} RENAME TO {target}")
        raise
    spark.sql(f"DROP TABLE {old}")


def _same_table(spark: SparkSession, df: DataFrame, target: str, fmt: str, facts: TableFacts) -> dict | None:
    """The properties of ``target`` if it is a copy with these columns, format and layout."""
    if not _table_exists(spark, target):
        return None
    held = describe_table(spark, target)
    properties = held.get("table_properties") or {}
    same = (
        KIND in properties
        and held.get("provider") == fmt
        and tuple(held.get("partition_columns") or ()) == tuple(facts.partition_by)
        and sorted(spark.table(target).dtypes) == sorted(df.dtypes)
    )
    return {**properties, "comment of the table": held.get("comment")} if same else None


def _same_facts(properties: Mapping[str, str], facts: TableFacts) -> bool:
    own = {k: v for k, v in properties.items() if not k.startswith("continuity.")}
    comment = own.pop("comment of the table")
    return (
        properties[KIND] == facts.kind
        and own == dict(facts.properties)
        and (comment or None) == (facts.comment or None)
    )


def _up_to_date(spark: SparkSession, df: DataFrame, target: str, fmt: str, facts: TableFacts) -> bool:
    """Whether ``target`` is a verified copy of exactly these files under these facts."""
    if facts.files is None:
        return False
    held = _same_table(spark, df, target, fmt, facts)
    return held is not None and held.get(FILES) == facts.files and _same_facts(held, facts)


def _properties(facts: TableFacts) -> str:
    properties = {**facts.properties, KIND: facts.kind, FILES: facts.files or ""}
    for name, value in ((INDEX, facts.index), (RUN, facts.run)):
        if value:
            properties[name] = value
    return ", ".join(f"{text_literal(k)} = {text_literal(v)}" for k, v in properties.items())


def _beside(target: str, suffix: str) -> str:
    return f"{target[:-1]}{suffix}`" if target.endswith("`") else target + suffix


def _create(
    spark: SparkSession,
    df: DataFrame,
    name: str,
    version: str,
    fmt: str,
    facts: TableFacts,
    index: DataFrame | None,
) -> None:
    layout = ", ".join(quote(c) for c in facts.partition_by)
    spark.sql(
        f"CREATE TABLE {name} ({_columns_ddl(df)}) USING {fmt}"
        + (f" PARTITIONED BY ({layout})" if layout else "")
        + f" LOCATION {text_literal(version)}"
        + (f" COMMENT {text_literal(facts.comment)}" if facts.comment else "")
        + f" TBLPROPERTIES ({_properties(facts)})"
    )
    if index is not None:
        add_partitions(spark, name, index, facts.partition_by)


def _within(inner: str | None, outer: str | None) -> bool:
    if not inner or not outer:
        return False
    inner, outer = inner.rstrip("/"), outer.rstrip("/")
    return inner == outer or inner.startswith(outer + "/")


def replicate(
    spark: SparkSession,
    df: DataFrame,
    target: str,
    folder: str,
    facts: TableFacts,
    fmt: str = "parquet",
    same_layout: bool = True,
    skip_unchanged: bool = False,
) -> Copied:
    """Copy ``df`` to the table ``target``, its files below ``folder``.

    With ``skip_unchanged`` a copy made from the very same source files is left as it is, so
    a repeated run moves only tables that changed, and of a partitioned table only the
    partitions that did.
    """
    if fmt in ATOMIC_FORMATS:
        writer = df.writeTo(target).using(fmt).option("path", folder)
        properties = {**facts.properties, KIND: facts.kind}
        if facts.run:
            properties[RUN] = facts.run
        if facts.comment:
            properties["comment"] = facts.comment
        for key, value in properties.items():
            writer = writer.tableProperty(key, value)
        if facts.partition_by:
            writer = writer.partitionedBy(*[df[c] for c in facts.partition_by])
        writer.createOrReplace()
        return Copied()
    if _within(folder, facts.location):
        raise RuntimeError(f"target folder {folder} lies inside the source {facts.location}")
    if _table_exists(spark, target) and facts.location:
        current = describe_table(spark, target).get("location")
        if _within(facts.location, current):
            raise RuntimeError(f"{target} holds the files of its own source")
    rows = df if same_layout else clustered(df, facts.partition_by)
    if facts.partition_by:
        return _replicate_partitions(spark, df, rows, target, folder, facts, fmt, skip_unchanged)
    if skip_unchanged:
        # Taken before the rows are read: a change in between shows in the next run.
        facts = replace(facts, files=source_files(df))
        if _up_to_date(spark, df, target, fmt, facts):
            return Copied()
    version, n_rows = write_version(rows, folder, fmt)
    publish(spark, df, target, version, fmt, facts)
    return Copied(rows=n_rows)


def _replicate_partitions(
    spark: SparkSession,
    df: DataFrame,
    rows: DataFrame,
    target: str,
    folder: str,
    facts: TableFacts,
    fmt: str,
    skip_unchanged: bool,
) -> Copied:
    """Copy a partitioned table: all of it, or the partitions that differ from the last copy."""
    layout, folder = facts.partition_by, folder.rstrip("/")
    held = _same_table(spark, df, target, fmt, facts) if skip_unchanged else None
    # Taken before the rows are read: a change in between shows in the next run.
    now = source_parts(df, layout) if skip_unchanged else None
    now = None if now is None else stored(now, "partitions")
    known = None
    if held and held.get(INDEX) and now is not None:
        known = spark.read.parquet(held[INDEX])
        states = stored(compare_parts(known, now), "partitions")
        count = {r.state: r["count"] for r in states.groupBy("state").count().collect()}
        kept, dropped = count.get(SAME, 0), count.get(GONE, 0)
        moving = sum(count.values()) - kept - dropped
        if not moving and not dropped and _same_facts(held, facts):
            return Copied(kept=kept)
        rows = rows_of_parts(rows, layout, states.filter(~F.col("state").isin(SAME, GONE)))
    version, written = write_partitions(rows, folder, fmt, layout)
    index = f"{folder}/index/v_{run_id()}"
    if now is None:
        entries = written.withColumn("source", F.lit(None).cast("string"))
    else:
        entries = written.join(now, "part", "left")
    columns = ["part", "source", "content", "folder"]
    entries = entries.select(*columns)
    if known is not None:
        same = states.filter(F.col("state") == SAME).select("part")
        entries = entries.unionByName(known.join(same, "part", "left_semi").select(*columns))
    entries.write.parquet(index)
    held_now = spark.read.parquet(index)
    publish(spark, df, target, version, fmt, replace(facts, index=index), held_now)
    total = written.agg(F.sum("content.rows"), F.count(F.lit(1))).first()
    return Copied(
        rows=total[0] or 0,
        written=total[1],
        kept=kept if known is not None else 0,
        dropped=dropped if known is not None else 0,
    )


def replicate_named(
    spark: SparkSession,
    source: str,
    target: str,
    folder: str,
    fmt: str | None = None,
    skip_unchanged: bool = False,
    run: str | None = None,
) -> Copied:
    """Full copy of a table by name: rows, columns, partitioning, comment and properties.

    ``run``: the name of a journaled run, kept with the copy."""
    df, facts = read_named(spark, source), replace(table_facts(spark, source), run=run)
    fmt = copy_format(fmt, facts.provider)
    return replicate(spark, df, target, folder, facts, fmt, skip_unchanged=skip_unchanged)


def replicate_path(
    spark: SparkSession,
    source_location: str,
    target: str,
    target_location: str,
    source_fmt: str = "parquet",
    fmt: str | None = None,
    skip_unchanged: bool = False,
    run: str | None = None,
) -> Copied:
    """Full copy of the table stored at a path, partitioning included, to a target path."""
    df = read_path(spark, source_location, source_fmt)
    layout = path_partitions(df, source_location)
    facts = TableFacts(partition_by=layout, location=source_location, run=run)
    fmt = copy_format(fmt, source_fmt)
    return replicate(spark, df, target, target_location, facts, fmt, skip_unchanged=skip_unchanged)


def _made_in(spark: SparkSession, target: str, run: str) -> bool:
    """Whether ``target`` was published by this run, whatever its journal says."""
    if not _table_exists(spark, target):
        return False
    return (describe_table(spark, target).get("table_properties") or {}).get(RUN) == run


def run_clone_plan(
    spark: SparkSession,
    plan: DataFrame,
    log: StatusLog,
    source_of: Callable[[Row], str],
    target_of: Callable[[Row], str],
    folder_of: Callable[[Row], str],
    fmt: str | None = None,
    workers: int = 8,
    fail_fast: bool = False,
    skip_unchanged: bool = False,
) -> None:
    """Copy every table of a plan, several at a time, one status row each.

    A failed copy becomes a status row and the others go on. Only the plan's rows come to
    the driver, in pieces; the rows of the tables never do.
    """

    def copy(row: Row) -> Status:
        # Jobs within one pool queue up, so each thread has a pool of its own.
        pool, kind = threading.current_thread().name, f"table_by_{row.kind}"
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        try:
            log.begin(record(row.catalog, row.schema, row.table, kind, None))
            if row.problem:
                raise RuntimeError(row.problem)
            if log.run and _made_in(spark, target_of(row), log.run):
                pass
            elif row.kind == BY_NAME:
                replicate_named(
                    spark,
                    source_of(row),
                    target_of(row),
                    folder_of(row),
                    fmt,
                    skip_unchanged,
                    log.run,
                )
            else:
                replicate_path(
                    spark,
                    row.source_location,
                    target_of(row),
                    row.target_location,
                    row.format or "parquet",
                    fmt,
                    skip_unchanged,
                    log.run,
                )
            status = SUCCESS
        except Exception as error:
            if fail_fast:
                raise
            status = failure(error)
        return record(row.catalog, row.schema, row.table, kind, status)

    for by in (BY_NAME, BY_PATH):
        waiting = log.remaining(plan.filter(F.col("kind") == by), f"table_by_{by}", "table")
        for status in run_each(copy, waiting.toLocalIterator(prefetchPartitions=True), workers):
            log.add(status)
