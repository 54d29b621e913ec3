"""The two ways a table to copy is read: by its name or by its storage path."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession


def read_named(spark: SparkSession, identifier: str) -> DataFrame:
    return spark.table(identifier)


def read_path(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table by its path. Values in folder names stay as they are written, as strings: a
    guessed type would turn ``007`` into 7. The setting is made on a session of its own."""
    apart = spark.newSession()
    apart.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    schema = apart.read.format(fmt).load(path).schema
    return spark.read.schema(schema).format(fmt).load(path)


def path_partitions(df: DataFrame, path: str) -> tuple[str, ...]:
    """Columns that a table read from ``path`` keeps in folder names, seen on one file."""
    row = df.select("_metadata.file_path").first()
    if row is None:
        return ()
    base = urlsplit(path).path.rstrip("/")
    below = unquote(urlsplit(row.file_path).path).split(base, 1)[-1]
    names = [folder.split("=", 1)[0] for folder in below.split("/")[:-1] if "=" in folder]
    return tuple(name for name in names if name in df.columns)
