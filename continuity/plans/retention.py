"""Remove versions of copies that nothing points into any more.

Every copy writes a version folder and, if it is partitioned, an index; publishing leaves the
old ones where they are. A version is in use while the catalog's entry of a table lies in it, or
the index of that entry names a partition in it, or is it.

Versions are listed before the catalog is asked, and a copy only ever points at versions that the
entry before it pointed at, or at new ones. So nothing that comes into use in between is among
those that are found unused, except versions that are just being written: these are kept by a
time of grace, counted from their newest file. A copy must be published within that time.

Version names are random and of one form, so they are compared by name: addresses of one folder
may be written in several ways.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from continuity.files import Files
from continuity.functions.names import quote
from continuity.operators.joins import keyed_join
from continuity.plans.replicate import INDEX
from continuity.plans.status import failure
from continuity.sources.inventory import describe_table, write_rows
from continuity.threads import run_each
from continuity.workspace import run_folder, stored

REMOVED, UNUSED = "REMOVED", "UNUSED"
GRACE = datetime.timedelta(days=7)

# The form of ``run_id`` in the names of version folders.
_VERSION = r"v_[0-9a-f]{12}"
# Indexes read by one job.
_INDEXES = 500


def _versions_in(path: str) -> Column:
    """All version folders on the way of a path: a copy may lie below another one's version,
    which is then in use as well."""
    return F.filter(F.split(path, "/"), lambda name: name.rlike(f"^{_VERSION}$"))


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version, folder, n_files, bytes, changed) of every version below ``folder``: its name, its
    place relative to ``folder``, and the time of its newest file. One that lies in another is
    part of it.

    The files are listed by Spark, their contents are not read. Files that are still hidden from
    readers (an unfinished write) make no version.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    home = Files(spark, folder).address()
    inside = F.substring("path", F.lit(len(home) + 2), F.char_length("path"))
    place = F.regexp_extract(inside, f"^((?:.*?/)??{_VERSION})/", 1)
    return (
        files.select(place.alias("folder"), "length", "modificationTime")
        .filter("folder <> ''")
        .groupBy(F.substring_index("folder", "/", -1).alias("version"), "folder")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum("length").alias("bytes"),
            F.max("modificationTime").alias("changed"),
        )
    )


def _entries(
    spark: SparkSession, databases: Iterable[str] | None, workers: int
) -> Iterator[tuple[str | None, str | None]]:
    """(location, index) of every table of the databases."""
    if databases is None:
        databases = (r[0] for r in spark.sql("SHOW DATABASES").toLocalIterator())

    def names() -> Iterator[str]:
        for database in databases:
            for listed in spark.sql(f"SHOW TABLES IN {quote(database)}").toLocalIterator():
                if not listed.isTemporary:
                    yield quote(database, listed.tableName)

    def entry(name: str) -> tuple[str | None, str | None]:
        facts = describe_table(spark, name)
        return facts.get("location"), (facts.get("table_properties") or {}).get(INDEX)

    return run_each(entry, names(), workers)


def versions_in_use(
    spark: SparkSession, databases: Iterable[str] | None = None, workers: int = 8
) -> DataFrame:
    """(version) that tables of the databases (all, if none are named) point into.

    An index that cannot be read raises: its partitions are not known to be unused.
    """
    folder = run_folder(spark, "in_use")
    entries = write_rows(
        spark, _entries(spark, databases, workers), "location string, index string",
        f"{folder}/entries", 1000,
    )
    for path in ("location", "index"):
        named = entries.select(F.explode(_versions_in(path)).alias("version"))
        named.write.mode("append").parquet(f"{folder}/versions")
    waiting: list[str] = []

    def read() -> None:
        held = spark.read.schema("folder string").parquet(*waiting)
        named = held.select(F.explode(_versions_in("folder")).alias("version")).distinct()
        named.write.mode("append").parquet(f"{folder}/versions")
        waiting.clear()

    for row in entries.filter("index IS NOT NULL").select("index").toLocalIterator():
        waiting.append(row["index"])
        if len(waiting) >= _INDEXES:
            read()
    if waiting:
        read()
    return spark.read.schema("version string").parquet(f"{folder}/versions").distinct()


def unused_versions(
    spark: SparkSession,
    folder: str,
    databases: Iterable[str] | None = None,
    grace: datetime.timedelta = GRACE,
    workers: int = 8,
) -> DataFrame:
    """The versions below ``folder`` that no table points into and that are older than the grace.

    Name all databases whose tables may have copies there, or none for all of the catalog.
    """
    # Now, before the catalog is asked.
    there = stored(versions(spark, folder), "versions")
    old = there.filter(F.col("changed") <= F.current_timestamp() - F.lit(grace))
    used = versions_in_use(spark, databases, workers)
    return keyed_join(old, used, ["version"], "left_anti")


def remove_unused(
    spark: SparkSession,
    folder: str,
    databases: Iterable[str] | None = None,
    grace: datetime.timedelta = GRACE,
    dry_run: bool = True,
    workers: int = 8,
) -> DataFrame:
    """Remove the unused versions below ``folder``: (folder, n_files, bytes, status) of each.

    A dry run, the default, only tells them (``UNUSED``). Removing one takes a call to the store
    from the driver, several at a time; one that fails becomes a row and the others go on. A
    stopped removal can be started again.
    """
    unused = stored(
        unused_versions(spark, folder, databases, grace, workers).select("folder", "n_files", "bytes"),
        "unused_versions",
    )
    if dry_run:
        return unused.withColumn("status", F.lit(UNUSED))
    files = Files(spark, folder)

    def remove(row: Row) -> tuple[str, int, int, str]:
        try:
            files.delete(row.folder)
            status = REMOVED
        except Py4JJavaError as error:
            status = failure(error.java_exception.toString())
        return row.folder, row.n_files, row.bytes, status

    return write_rows(
        spark,
        run_each(remove, unused.toLocalIterator(), workers),
        "folder string, n_files bigint, bytes bigint, status string",
        run_folder(spark, "removed_versions"),
        1000,
    )
