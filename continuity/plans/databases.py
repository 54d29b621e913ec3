"""Create the schemas the target lacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession

from continuity.functions.names import quote, text_literal
from continuity.plans.status import SUCCESS, StatusLog, failure, record


def create_schemas(
    spark: SparkSession,
    missing: DataFrame,
    log: StatusLog,
    database_of: Callable[[str, str], str],
    folder_of: Callable[[Row], str] | None = None,
) -> None:
    """``CREATE DATABASE IF NOT EXISTS`` per missing schema, with its comment and properties.

    Existing schemas are not touched and none is dropped.
    """
    for row in log.remaining(missing, "schema", None).toLocalIterator():
        log.begin(record(row.catalog, row.schema, None, "schema", None))
        try:
            statement = f"CREATE DATABASE IF NOT EXISTS {quote(database_of(row.catalog, row.schema))}"
            if row.comment:
                statement += f" COMMENT {text_literal(row.comment)}"
            if folder_of is not None:
                statement += f" LOCATION {text_literal(folder_of(row))}"
            if row.properties:
                pairs = ", ".join(
                    f"{text_literal(k)} = {text_literal(v)}" for k, v in row.properties.items()
                )
                statement += f" WITH DBPROPERTIES ({pairs})"
            spark.sql(statement)
            status = SUCCESS
        except Exception as error:
            status = failure(error)
        log.add(record(row.catalog, row.schema, None, "schema", status))
