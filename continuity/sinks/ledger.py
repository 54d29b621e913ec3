"""Appends that can be repeated: a batch that was appended before adds nothing.

A batch is named by its source and a key of the caller's (for a stream its number). Its rows are
written to a hidden folder of the table and become part of the table by one rename to a folder
whose name follows from source and key. A batch that was stopped before the rename left nothing
that readers see; after it, the folder is there and a repeat is told by it. Two attempts at the
same batch cannot both get the name.

The table reads its batch folders because it is made with ``recursiveFileLookup``, which rules out
a layout by partitions. The ledger, one small file per batch, says what came when.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from continuity.files import Files
from continuity.sources.inventory import describe_table
from continuity.workspace import run_id

LEDGER_DDL = "source string, batch string, rows bigint, appended_at bigint, folder string"
_LEDGER, _STAGING = "_ledger", "_staging"
_NESTED = "recursivefilelookup"


def _home(spark: SparkSession, table: str) -> str:
    facts = describe_table(spark, table)
    options = {k.lower(): v for k, v in (facts.get("storage_properties") or {}).items()}
    if options.get(_NESTED) != "true":
        raise ValueError(f"{table} was not made for repeatable appends")
    return facts["location"]


def create_table(df: DataFrame, table: str, fmt: str = "parquet") -> None:
    """An empty table with the columns of ``df`` that takes repeatable appends."""
    columns = df._jdf.schema().toDDL()
    df.sparkSession.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING {fmt} OPTIONS ({_NESTED} 'true')"
    )


def _folder_of(source: str, batch: str) -> str:
    return "batch_" + hashlib.sha256(json.dumps([source, batch]).encode()).hexdigest()[:40]


def append_once(df: DataFrame, table: str, source: str, batch: str, fmt: str = "parquet") -> bool:
    """Append ``df`` to ``table`` as this batch of this source, creating the table when absent.

    Returns whether rows were added: false for a batch that is there already. Columns are matched
    by name; another set of columns is refused.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        create_table(df, table, fmt)
    files = Files(spark, _home(spark, table))
    folder = _folder_of(source, batch)
    if files.exists(folder):
        # Stopped between the two: the rows are in, the ledger does not know yet.
        _enter(files, source, batch, folder, None)
        return False
    held = spark.table(table)
    if sorted(held.dtypes) != sorted(df.dtypes):
        raise ValueError(f"columns {sorted(df.dtypes)} do not fit {table}: {sorted(held.dtypes)}")
    staging = f"{_STAGING}/{folder}_{run_id()}"
    seen = Observation(f"append_{run_id()}")
    rows = df.select(*["`" + c.replace("`", "``") + "`" for c in held.columns])
    provider = describe_table(spark, table)["provider"]
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(provider).save(
        f"{files.folder}/{staging}"
    )
    if not files.rename_new(staging, folder):
        files.delete(staging)
        return False
    spark.catalog.refreshTable(table)
    _enter(files, source, batch, folder, int(seen.get.get("rows") or 0))
    return True


def _enter(files: Files, source: str, batch: str, folder: str, rows: int | None) -> None:
    entry = {
        "source": source, "batch": batch, "rows": rows, "appended_at": time.time_ns(), "folder": folder,
    }
    if not files.exists(f"{_LEDGER}/{folder}.json"):
        files.make_folder(_LEDGER)
        files.write_new(f"{_LEDGER}/{folder}.json", json.dumps(entry))


def batch_ledger(spark: SparkSession, table: str) -> DataFrame:
    """The batches a table was made of; rows is null for one whose count was lost."""
    home = _home(spark, table)
    Files(spark, home).make_folder(_LEDGER)
    return spark.read.schema(LEDGER_DDL).json(f"{home}/{_LEDGER}")


def append_stream_once(
    df: DataFrame,
    table: str,
    checkpoint_location: str,
    source: str = "stream",
    available_now: bool = True,
) -> StreamingQuery:
    """Append a stream batch by batch, each under its number.

    A batch whose rows were added but whose end the checkpoint does not know is run again after a
    restart and adds nothing. Numbers belong to one checkpoint: a stream with a new one is another
    source.
    """
    if not checkpoint_location:
        raise ValueError("a streaming append needs a checkpoint_location")
    if not df.sparkSession.catalog.tableExists(table):
        create_table(df, table)

    def take(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_once(batch, table, f"{source}/{stream}", str(number))
        # The stream has a session of its own; the caller's knows older files of the table.
        df.sparkSession.catalog.refreshTable(table)

    writer = df.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
