"""Where intermediate tables, snapshots and status rows are written.

Everything goes below the shared folder of the cluster (``spark.checkpoint.dir``), so a lost
executor or a restarted driver can read it again. A machine-local folder is used only by a
local session that names none.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from continuity.functions.names import quote, text_literal


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="continuity-"))
    return context.getCheckpointDir().rstrip("/")


def run_id() -> str:
    return uuid.uuid4().hex[:12]


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run. The name has no ``=``, which Spark would read as a partition."""
    return f"{shared_folder(spark)}/continuity/{purpose}_{run_id()}"


def run_database(spark: SparkSession, purpose: str) -> str:
    """A new database whose tables lie in the shared folder, not in a local warehouse."""
    name = f"continuity_{purpose}_{run_id()}"
    folder = f"{shared_folder(spark)}/continuity/{name}"
    spark.sql(f"CREATE DATABASE {quote(name)} LOCATION {text_literal(folder)}")
    return name


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, short lineage,
    known size, and still there when executors or the driver are lost."""
    folder = run_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
