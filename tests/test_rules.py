from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from continuity.functions import delay_type, first_match

COLUMNS = (
    "WeatherDelay string, NASDelay string, SecurityDelay string, LateAircraftDelay string, "
    "IsArrDelayed string, IsDepDelayed string"
)
NA = "NA"

CAUSES = [column.split()[0] for column in COLUMNS.split(", ")][:4]
# Null, the marker, and values that are neither: an empty string, numbers, a header's name.
GIVEN = (None, NA, "", "0", "15", "WeatherDelay")
FLAGS = (None, "NO", "YES", "yes")


def expected(values):
    """The first cause that is given, else whether a delay is flagged."""
    for name, value in zip(CAUSES, values, strict=False):
        if value is not None and value != NA:
            return name
    return "UncategorizedDelay" if "YES" in values[4:] else None


def cases():
    for causes in itertools.product(GIVEN, repeat=4):
        for flags in itertools.product(FLAGS, repeat=2):
            yield (*causes, *flags)


def test_delay_type_by_case(spark):
    data = [(i, *values) for i, values in enumerate(cases())]
    labelled = delay_type(spark.createDataFrame(data, "i int, " + COLUMNS))
    got = {r.i: r.delay_type for r in labelled.select("i", "delay_type").collect()}
    assert got == {i: expected(values) for i, *values in data}


def test_carrier_is_no_cause(spark):
    df = spark.createDataFrame(
        [("5", NA, NA, NA, NA, "NO", "NO"), ("5", NA, NA, NA, NA, "YES", "NO")],
        "CarrierDelay string, " + COLUMNS,
    )
    assert [r.delay_type for r in delay_type(df).collect()] == [None, "UncategorizedDelay"]


def test_first_match_takes_columns_as_labels(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "a int, b string")
    label = first_match([(F.col("a") == 1, F.col("b")), (F.col("a") <= 2, "two")])
    assert [r.l for r in df.select(label.alias("l")).collect()] == ["x", "two", None]


def test_first_match_without_rules():
    with pytest.raises(ValueError):
        first_match([])
