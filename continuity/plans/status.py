"""Status rows: what became of each object of a run."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from continuity.schemas import STATUS_DDL
from continuity.sources.inventory import Inventory
from continuity.workspace import run_folder, stored

SUCCESS = "SUCCESS"


class Status(NamedTuple):
    catalog: str | None
    schema: str | None
    table: str | None
    kind: str
    status: str | None
    sync_time: int


def record(
    catalog: str | None, schema: str | None, table: str | None, kind: str, status: str | None
) -> Status:
    return Status(catalog, schema, table, kind, status, time.time_ns())


def failure(error: BaseException | str) -> str:
    if isinstance(error, PySparkException):
        error = error.getMessage() or str(error)
    return f"FAIL: {str(error).strip() or type(error).__name__}"


class StatusLog:
    """Collects status rows and writes them to the shared folder every ``batch`` rows, so a
    long run keeps few of them in the driver and a lost driver leaves what was done."""

    def __init__(self, spark: SparkSession, folder: str | None = None, batch: int = 1000):
        self._spark = spark
        self._folder = folder or run_folder(spark, "status")
        self._batch = batch
        self._waiting: list[Status] = []
        spark.createDataFrame([], STATUS_DDL).write.mode("append").parquet(self._folder)

    def add(self, status: Status) -> None:
        self._waiting.append(status)
        if len(self._waiting) >= self._batch:
            self._flush()

    # A log of one start only: nothing was done before, and nothing is marked. See ``Journal``.
    run: str | None = None

    def begin(self, status: Status) -> None:
        """Mark an object as begun."""

    def remaining(self, plan: DataFrame, kind: str, name: str | None) -> DataFrame:
        """The rows of a plan whose objects (``name``: their column) were not finished before."""
        return plan

    def once(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, worked out once for this run."""
        return stored(df, name)

    def inventory(self, side: str, listed: Inventory) -> Inventory:
        """The inventory of a side this run goes by."""
        return listed

    def add_frame(self, statuses: DataFrame, name: str) -> None:
        """Statuses worked out in Spark; they never pass through the driver."""
        columns = [field.split()[0] for field in STATUS_DDL.split(",")]
        statuses.select(*columns).write.mode("append").parquet(self._folder)

    def _flush(self) -> None:
        if self._waiting:
            rows = self._spark.createDataFrame(self._waiting, STATUS_DDL)
            rows.coalesce(1).write.mode("append").parquet(self._folder)
            self._waiting = []

    def frame(self) -> DataFrame:
        self._flush()
        return self._spark.read.schema(STATUS_DDL).parquet(self._folder)


def stamped(statuses: DataFrame) -> DataFrame:
    """Add ``sync_time`` in epoch nanoseconds (the clock gives microseconds)."""
    return statuses.withColumn("sync_time", F.unix_micros(F.current_timestamp()) * 1000)


def outcome(status: str = "status") -> Column:
    """The status without its message: SUCCESS, FAIL, ..."""
    return F.regexp_extract(status, "^[^:]*", 0)
