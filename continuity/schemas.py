"""Declared schemas: the flight files, the inventories and the status rows."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, order and types of the header-less flight files.
FLIGHT_DDL = """
    Year int, Month int, DayofMonth int, DayOfWeek int,
    DepTime string, CRSDepTime int, ArrTime string, CRSArrTime int,
    UniqueCarrier string, FlightNum int, TailNum string,
    ActualElapsedTime string, CRSElapsedTime int, AirTime string,
    ArrDelay string, DepDelay string, Origin string, Dest string,
    Distance string, TaxiIn string, TaxiOut string,
    Cancelled int, CancellationCode string, Diverted int,
    CarrierDelay string, WeatherDelay string, NASDelay string,
    SecurityDelay string, LateAircraftDelay string,
    IsArrDelayed string, IsDepDelayed string
"""

CATALOGS_DDL = "catalog string, catalog_type string"
SCHEMAS_DDL = "catalog string, schema string, comment string, properties map<string,string>"
TABLES_DDL = (
    "catalog string, schema string, name string, table_type string, format string, "
    "storage_location string, view_definition string, owner string"
)
VOLUMES_DDL = (
    "catalog string, schema string, name string, volume_type string, "
    "storage_location string, owner string"
)
LOCATIONS_DDL = "name string, url string"
GRANTS_DDL = "securable_type string, full_name string, principal string, privilege string"
SECURABLES_DDL = "securable_type string, full_name string, catalog string, schema string"
STATUS_DDL = (
    "catalog string, schema string, table string, kind string, status string, sync_time bigint"
)


_FLIGHT_TYPES = {"int": T.IntegerType(), "string": T.StringType()}


def flight_schema() -> T.StructType:
    """The 31 nullable columns of a flight file, in file order."""
    schema = T.StructType()
    for column in FLIGHT_DDL.split(","):
        name, kind = column.split()
        schema.add(name, _FLIGHT_TYPES[kind], nullable=True)
    return schema
