"""Partitions of a copy: what each was made of, and which of them have to be made again.

Every version of a partitioned copy has an index beside it, one row per partition:

- ``part``: the partition's values, a struct of the layout's columns,
- ``source``: digest of the source files its rows came from (path, size, time of each),
- ``content``: digest of the rows that were written, taken when they were read back,
- ``folder``: where its files are, a folder of this version or of an earlier one.

The index of the last version joined with the digests of the source's files now says which
partitions are the same, changed, new or gone. Only changed and new ones are read, written and
verified; the next index takes the others over as they are, and the catalog's partitions point
into the folders of several versions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice
from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from continuity.functions.digest import digest_aggregates
from continuity.functions.names import quote, text_literal
from continuity.operators.joins import keyed_join

SAME, CHANGED, NEW, GONE = "same", "changed", "new", "gone"
# Spark's folder name for a null (and an empty) partition value.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
# Partitions named in one statement.
BATCH = 200
# Up to this many partitions are named in the scan's filter; more are found by a join.
NAMED = 400

_FILE = ("file_path", "file_size", "file_modification_time")


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def part_of(df: DataFrame, layout: Sequence[str]) -> Column:
    """The partition values of a row. A folder name cannot tell an empty text from null."""
    return F.struct(
        *[
            (F.nullif(_column(c), F.lit("")) if df.schema[c].dataType == T.StringType() else _column(c)).alias(c)
            for c in layout
        ]
    )


def _digest_text(df: DataFrame) -> Column:
    return F.to_json(F.struct(*digest_aggregates(df)))


def source_parts(df: DataFrame, layout: Sequence[str]) -> DataFrame | None:
    """(part, source) of the files that ``df`` reads now, None if it reads no plain files.

    Only partition values and the hidden metadata column are asked for, so a source with this
    layout answers without reading its rows; files are told apart on the map side.
    """
    try:
        files = df.select(
            part_of(df, layout).alias("part"), *[F.col(f"_metadata.{c}").alias(c) for c in _FILE]
        ).distinct()
    except AnalysisException:
        return None
    return files.groupBy("part").agg(_digest_text(files.select(*_FILE)).alias("source"))


def written_parts(copy: DataFrame, layout: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(part, content, folder) of a version that was just written, read back once."""
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
    rows = copy.select(*[_column(c) for c in columns])
    return copy.groupBy(part_of(copy, layout).alias("part")).agg(
        F.struct(*digest_aggregates(rows)).alias("content"), F.min(folder).alias("folder")
    )


def compare_parts(held: DataFrame, now: DataFrame) -> DataFrame:
    """(part, source, state) for every partition of the held index or of the source now.

    One aggregate with a flag per side, combined on the map side. A held partition that does not
    know its source's files counts as changed.
    """
    rows = held.select("part", F.col("source").alias("held"), F.lit(None).cast("string").alias("now")).unionByName(
        now.select("part", F.lit(None).cast("string").alias("held"), F.col("source").alias("now"))
        .withColumn("here", F.lit(True)),
        allowMissingColumns=True,
    )
    seen = rows.groupBy("part").agg(
        F.max("held").alias("held"),
        F.max("now").alias("now"),
        F.max(F.coalesce("here", F.lit(False))).alias("here"),
        F.min(F.coalesce("here", F.lit(False))).alias("only_here"),
    )
    state = (
        F.when(~F.col("here"), GONE)
        .when(F.col("only_here"), NEW)
        .when(F.col("held") == F.col("now"), SAME)
        .otherwise(CHANGED)
    )
    return seen.select("part", F.col("now").alias("source"), state.alias("state"))


def rows_of_parts(
    df: DataFrame, layout: Sequence[str], parts: DataFrame, named: int = NAMED
) -> DataFrame:
    """The rows of ``df`` in the partitions (part) of ``parts``.

    A bounded number of partitions is written into the filter, which prunes the scan before it
    starts. Beyond that the values come by a join, whose broadcast side prunes while it runs.
    """
    some = parts.select("part").limit(named + 1).collect()
    if len(some) <= named:
        return df.filter(_any_of(df, layout, [r.part for r in some]))
    key = part_of(df, layout)
    marked = df.withColumn("__part", key)
    wanted = parts.select(F.col("part").alias("__part"))
    return keyed_join(marked, wanted, ["__part"], "left_semi").drop("__part")


def _any_of(df: DataFrame, layout: Sequence[str], parts: list[Row]) -> Column:
    if not parts:
        return F.lit(False)
    if len(layout) == 1:
        # One list, which also file formats and catalogs understand.
        name = layout[0]
        values = [p[0] for p in parts]
        present = [v for v in values if v is not None]
        found = _column(name).isin(present) if present else F.lit(False)
        if None not in values:
            return found
        nothing = _column(name).isNull()
        if df.schema[name].dataType == T.StringType():
            nothing = nothing | (_column(name) == "")
        return found | nothing
    key = part_of(df, layout)
    chosen = F.lit(False)
    for part in parts:
        one = F.lit(True)
        for name, value in zip(layout, part, strict=True):
            one = one & key[name].eqNullSafe(F.lit(value))
        chosen = chosen | one
    return chosen


def _spec(folder: str, layout: Sequence[str]) -> str:
    """The partition's values as its folder names them, for a statement."""
    segments = urlsplit(folder).path.rstrip("/").split("/")[-len(layout) :]
    values = []
    for name, segment in zip(layout, segments, strict=True):
        # Once for the address, once for what a folder name cannot hold.
        value = unquote(unquote(segment).split("=", 1)[1])
        shown = "NULL" if value == _NO_VALUE else text_literal(value)
        values.append(f"{quote(name)} = {shown}")
    return ", ".join(values)


def plain_path(address: str) -> str:
    """A folder without the escapes of an address, as statements want it."""
    parts = urlsplit(address)
    if not parts.scheme:
        return address
    host = f"//{parts.netloc}" if parts.netloc else ""
    return f"{parts.scheme}:{host}{unquote(parts.path)}"


def add_partitions(
    spark: SparkSession, table: str, index: DataFrame, layout: Sequence[str], batch: int = BATCH
) -> None:
    """Enter every partition of the index into the catalog, some at a time. Nothing is listed,
    and only one piece of the index is in the driver."""
    rows: Iterator[Row] = iter(index.select("folder").toLocalIterator())
    while chunk := list(islice(rows, batch)):
        entries = " ".join(
            f"PARTITION ({_spec(r.folder, layout)}) LOCATION {text_literal(plain_path(r.folder))}"
            for r in chunk
        )
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {entries}")
