"""Cut a frame down for a look or a trial run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def first_rows(df: DataFrame, n: int = 1000) -> DataFrame:
    """Any ``n`` rows; which ones is unspecified. Keeps the scan's ``_metadata``."""
    return df.limit(n)


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in ``order``: the repeatable form of ``first_rows``.

    Every task keeps its own best ``n``, only those meet in the last one.
    """
    return df.orderBy(*order).limit(n)
