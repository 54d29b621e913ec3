"""Delimited files split into good rows and bad lines, from one read.

A line is bad when Spark's own parser could not take it whole: a cell that is not of its declared
type, too few cells, too many. Nothing is lost: every line becomes either a good row or a bad line
with its file and the reasons. A bad line's cells are parsed a second time as text, and a cell that
has text where the read has nothing is the evidence.

Lines and records must be the same (no ``multiLine``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from continuity.schemas import flight_schema
from continuity.sinks.ledger import append_once, create_table
from continuity.workspace import stored

BAD_DDL = "source_file string, line string, reason string"
_LINE, _FILE, _REASON = "__line", "__file", "__reason"


def _declared(schema: T.StructType | str | None) -> T.StructType:
    if schema is None:
        return flight_schema()
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _options(options: dict[str, str]) -> dict[str, str]:
    lowered = {k.lower() for k in options}
    taken = lowered & {"multiline", "mode", "columnnameofcorruptrecord", "columnpruning"}
    if taken:
        raise ValueError(f"options not allowed here: {sorted(taken)}")
    # Lines are always cut into all their cells: otherwise a query that wants few columns would
    # not see that some are missing.
    return {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LINE, "columnPruning": "false"}


def _cells(line: Column, options: dict[str, str]) -> Column:
    """How many cells a line has: separators outside quotes, and one."""
    given = {k.lower(): v for k, v in options.items()}
    separator = given.get("sep", given.get("delimiter", ","))
    quote, escape = given.get("quote", '"'), given.get("escape", "\\")
    q, e = (f"\\x{{{ord(c):x}}}" for c in (quote, escape))
    quoted = f"{q}[^{q}]*{q}" if quote == escape else f"{q}(?:[^{q}{e}]|{e}.)*{q}"
    bare = F.regexp_replace(line, quoted, "")
    return (F.char_length(bare) - F.char_length(F.replace(bare, F.lit(separator), F.lit("")))) / len(
        separator
    ) + 1


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _reason(schema: T.StructType, told: Column, count: Column) -> Column:
    """What is wrong with a bad line, joined by semicolons. ``told``: its cells as text."""
    n = len(schema)
    shown = F.concat(count.cast("string"), F.lit(f" of {n}"))
    reasons = [
        F.when(count < n, F.concat(F.lit("too few cells: "), shown)).when(
            count > n, F.concat(F.lit("too many cells: "), shown)
        )
    ]
    for k, field in enumerate(schema.fields):
        if isinstance(field.dataType, T.StringType):
            continue
        cell = told[f"c{k}"]
        said = F.concat(
            F.lit(f"{field.name}: '"), cell, F.lit(f"' is no {field.dataType.simpleString()}")
        )
        reasons.append(F.when(_column(field.name).isNull() & cell.isNotNull(), said))
    listed = F.array_join(F.array_compact(F.array(*reasons)), "; ")
    return F.when(listed == "", "cannot be parsed").otherwise(listed)


def read_judged(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    streaming: bool = False,
    **options: str,
) -> DataFrame:
    """Every line of the files as one row: the declared columns, and of a bad line also the line,
    its file and the reason (null for a good one). ``good_rows`` and ``bad_lines`` take it apart."""
    declared = _declared(schema)
    held = T.StructType([*declared.fields, T.StructField(_LINE, T.StringType())])
    reader = (spark.readStream if streaming else spark.read).format("csv").options(**_options(options))
    # A cell is looked at only if its column is wanted, and a query that wants nothing but the
    # line is refused: so the line leans on all columns that can have faults.
    typed = [f.name for f in declared.fields if not isinstance(f.dataType, T.StringType)]
    leaned_on = F.hash(*[_column(name) for name in typed or declared.names[:1]])
    anchored = F.concat(F.col(_LINE), F.substring(leaned_on.cast("string"), 1, 0))
    read = reader.schema(held).load(path).withColumn(_LINE, anchored)
    line = F.col(_LINE)
    texts = ", ".join(f"c{k} string" for k in range(len(declared)))
    # Faults are looked for in bad lines only.
    cells = F.from_csv(line, texts, {k: v for k, v in options.items() if k.lower() != "header"})
    parsed = read.withColumn("__cells", F.when(line.isNotNull(), cells))
    reason = _reason(declared, F.col("__cells"), _cells(line, options).cast("int"))
    return parsed.withColumns(
        {
            _FILE: F.when(line.isNotNull(), F.col("_metadata.file_path")),
            _REASON: F.when(line.isNotNull(), reason),
        }
    ).drop("__cells")


def good_rows(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col(_REASON).isNull()).drop(_LINE, _FILE, _REASON)


def bad_lines(judged: DataFrame) -> DataFrame:
    """(source_file, line, reason)"""
    return judged.filter(F.col(_REASON).isNotNull()).select(
        F.col(_FILE).alias("source_file"), F.col(_LINE).alias("line"), F.col(_REASON).alias("reason")
    )


def append_split(
    judged: DataFrame, table: str, quarantine: str, source: str, batch: str
) -> None:
    """Append the good rows to one table and the bad lines to another, both under the same batch
    (``append_once``), so that a batch that was stopped between the two is completed by a repeat.

    The files are read once: what was read is written to the shared folder and split from there.
    """
    held = stored(judged, "judged")
    append_once(bad_lines(held), quarantine, source, batch)
    append_once(good_rows(held), table, source, batch)


def append_split_stream(
    spark: SparkSession,
    path: str,
    table: str,
    quarantine: str,
    checkpoint_location: str,
    schema: T.StructType | str | None = None,
    source: str = "stream",
    max_files_per_trigger: int | None = None,
    **options: str,
) -> StreamingQuery:
    """The same for files as they arrive, batch by batch."""
    if not checkpoint_location:
        raise ValueError("a streaming append needs a checkpoint_location")
    if max_files_per_trigger is not None:
        options = {**options, "maxFilesPerTrigger": str(max_files_per_trigger)}
    judged = read_judged(spark, path, schema, streaming=True, **options)
    for part, name in ((good_rows(judged), table), (bad_lines(judged), quarantine)):
        if not spark.catalog.tableExists(name):
            create_table(part, name)

    def take(rows: DataFrame, number: int) -> None:
        stream = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_split(rows, table, quarantine, f"{source}/{stream}", str(number))
        for name in (table, quarantine):
            spark.catalog.refreshTable(name)

    writer = judged.writeStream.foreachBatch(take).trigger(availableNow=True)
    return writer.option("checkpointLocation", checkpoint_location).start()
