"""A journal of a run, so that a run that was stopped can go on where it was.

Everything lies in one folder that the caller names: what the run started from (inventories, plan),
an event before and one after each object, and the statuses that Spark works out. A run that is
started again with the same folder reads what is there, skips objects that were finished, and
returns the statuses of all its starts as one. A copy that was published just before the run was
stopped carries the run's name among its properties, so it is not made again although no event
tells of it.

An event is a file of its own, written beside and renamed, so none is ever half there.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from continuity.files import Files
from continuity.plans.status import Status, StatusLog
from continuity.schemas import STATUS_DDL
from continuity.sources.inventory import Inventory

BEGIN, END = "begin", "end"
_EVENT_DDL = f"phase string, {STATUS_DDL}"
_OBJECT = ["catalog", "schema", "table", "kind"]


class Journal(StatusLog):
    """A status log that survives the driver. With ``retry_failed`` objects that failed before
    are tried again, otherwise their status stands."""

    def __init__(self, spark: SparkSession, folder: str, retry_failed: bool = False):
        self._spark = spark
        self._folder = folder.rstrip("/")
        self._retry_failed = retry_failed
        self._files = Files(spark, self._folder)
        self.resumed = self._files.exists("events")
        self._files.make_folder("events")
        named = spark.range(1).select(F.lit(uuid.uuid4().hex).alias("run"))
        self.run = self.once("run", named).first().run

    # ---- frames that are worked out once ----

    def once(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` as it was when the run first got here. What a stopped write left is replaced."""
        place = f"{self._folder}/{name}"
        if not self._files.exists(f"{name}/_SUCCESS"):
            df.write.mode("overwrite").parquet(place)
        return self._spark.read.schema(df.schema).parquet(place)

    def inventory(self, side: str, listed: Inventory) -> Inventory:
        """The inventory the run started with, also if the side was listed again since."""
        parts = {f.name: getattr(listed, f.name) for f in fields(listed)}
        known = self.once(
            f"{side}/parts",
            self._spark.createDataFrame([(n,) for n, df in parts.items() if df is not None], "part string"),
        )
        held = {}
        for row in known.collect():
            given = parts[row.part]
            if given is None:
                given = getattr(listed.complete(self._spark), row.part)
            held[row.part] = self.once(f"{side}/{row.part}", given)
        return Inventory(**held)

    # ---- events ----

    def _event(self, phase: str, status: Status) -> None:
        name = f"events/{time.time_ns()}_{uuid.uuid4().hex}.json"
        self._files.write_new(name, json.dumps({"phase": phase, **status._asdict()}))

    def begin(self, status: Status) -> None:
        self._event(BEGIN, status)

    def add(self, status: Status) -> None:
        self._event(END, status)

    def add_frame(self, statuses: DataFrame, name: str) -> None:
        columns = [field.split()[0] for field in STATUS_DDL.split(",")]
        self.once(f"statuses/{name}", statuses.select(*columns))

    def _all_events(self) -> DataFrame:
        return self._spark.read.schema(_EVENT_DDL).json(f"{self._folder}/events")

    def _ended(self) -> DataFrame:
        """The last end of every object."""
        last = F.max_by(F.struct("status", "sync_time"), "sync_time").alias("last")
        ended = self._all_events().filter(F.col("phase") == END).groupBy(*_OBJECT).agg(last)
        return ended.select(*_OBJECT, "last.status", "last.sync_time")

    def unfinished(self) -> DataFrame:
        """(catalog, schema, table, kind) of objects that were begun and not ended."""
        return (
            self._all_events()
            .groupBy(*_OBJECT)
            .agg(F.max(F.col("phase") == END).alias("ended"))
            .filter("NOT ended")
            .select(*_OBJECT)
        )

    def remaining(self, plan: DataFrame, kind: str, name: str | None) -> DataFrame:
        if not self.resumed:
            return plan
        ended = self._ended().filter(F.col("kind") == kind)
        if self._retry_failed:
            ended = ended.filter(~F.coalesce(F.col("status").startswith("FAIL"), F.lit(False)))
        done = ended.select(
            F.col("catalog").alias("c_"), F.col("schema").alias("s_"), F.col("table").alias("t_")
        )
        same = F.col("catalog").eqNullSafe(F.col("c_")) & F.col("schema").eqNullSafe(F.col("s_"))
        if name is not None:
            same = same & F.col(name).eqNullSafe(F.col("t_"))
        return plan.join(done, same, "left_anti")

    def frame(self) -> DataFrame:
        columns = [field.split()[0] for field in STATUS_DDL.split(",")]
        found = self._ended().select(*columns)
        for name in ("volumes", "grants"):
            if self._files.exists(f"statuses/{name}/_SUCCESS"):
                place = f"{self._folder}/statuses/{name}"
                found = found.unionByName(self._spark.read.schema(STATUS_DDL).parquet(place))
        return found
