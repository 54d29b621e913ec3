"""Flights, inventories and grants derived from the test tables, in Spark.

``inputs_sql`` states the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from continuity.operators.joins import keyed_join
from continuity.schemas import flight_schema


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _text(prefix: str, column: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


def _yes(condition: Column) -> Column:
    return F.when(condition, "YES").otherwise("NO")


def flights(lineitem: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Line items in the shape of the 31 flight columns, after the columns in ``keep``."""
    flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    quantity, day = F.col("l_quantity").cast("int"), F.col("l_shipdate")
    no = F.lit("NA")
    columns = {
        "Year": F.year(day),
        "Month": F.month(day),
        "DayofMonth": F.dayofmonth(day),
        "DayOfWeek": line,
        "DepTime": F.when(line == 3, no).otherwise((F.col("l_orderkey") % 2400).cast("string")),
        "CRSDepTime": F.col("l_orderkey") % 2400,
        "ArrTime": (F.col("l_partkey") % 2400).cast("string"),
        "CRSArrTime": F.col("l_partkey") % 2400,
        "UniqueCarrier": _text("C", F.col("l_suppkey") % 20),
        "FlightNum": F.col("l_suppkey"),
        "TailNum": _text("N", "l_partkey"),
        "ActualElapsedTime": quantity.cast("string"),
        "CRSElapsedTime": quantity,
        "AirTime": no,
        "ArrDelay": (quantity - 25).cast("string"),
        "DepDelay": (line - 1).cast("string"),
        "Origin": _text("O", F.col("l_suppkey") % 300),
        "Dest": _text("D", F.col("l_partkey") % 300),
        "Distance": F.col("l_partkey").cast("string"),
        "TaxiIn": no,
        "TaxiOut": no,
        "Cancelled": F.when(flag == "R", 1).otherwise(0),
        "CancellationCode": F.when(flag == "R", status),
        "Diverted": F.lit(0),
        "CarrierDelay": F.when(line == 2, "5").otherwise("NA"),
        "WeatherDelay": F.when((flag == "R") & (status == "F"), quantity.cast("string")).otherwise(no),
        "NASDelay": F.when((flag == "A") & (status == "O"), line.cast("string")).otherwise(no),
        "SecurityDelay": F.when(F.col("l_tax") == 0, "0").otherwise("NA"),
        "LateAircraftDelay": F.when(F.col("l_discount") == 0, "0")
        .when(F.col("l_discount") == 0.1, F.lit(None).cast("string"))
        .otherwise("NA"),
        "IsArrDelayed": _yes(F.col("l_quantity") > 25),
        "IsDepDelayed": _yes(line == 1),
    }
    typed = [columns[f.name].cast(f.dataType).alias(f.name) for f in flight_schema().fields]
    return lineitem.select(*keep, *typed)


def brand_number() -> Column:
    return F.substring_index("p_brand", "#", -1).cast("int")


def _system() -> Column:
    return F.col("p_partkey") % 97 == 0


def _catalog() -> Column:
    return F.lower("p_type")


def _schema() -> Column:
    named = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_"))
    return F.when(_system(), "information_schema").otherwise(named)


def tables(part: DataFrame) -> DataFrame:
    """A table inventory: one object per part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = size % 4
    view = kind == 3
    place = (
        F.when(size % 7 == 0, _text("other://x/", key))
        .when(size % 7 == 1, F.concat(_text("src://r", size % 5), _text("/deep/", key)))
        .otherwise(F.concat(_text("src://r", size % 5), _text("/", key)))
    )
    return part.select(
        _catalog().alias("catalog"),
        _schema().alias("schema"),
        _text("t_", key).alias("name"),
        F.when(kind == 0, "MANAGED").when(view, "VIEW").otherwise("EXTERNAL").alias("table_type"),
        F.when(size % 3 == 0, "delta").otherwise("parquet").alias("format"),
        place.alias("storage_location"),
        F.when(view, F.concat(_text("SELECT ", key), F.lit(" AS k"))).alias("view_definition"),
        _text("o_", size % 5).alias("owner"),
    )


def catalogs(part: DataFrame) -> DataFrame:
    name = F.col("catalog")
    kind = F.when(F.length(name) % 2 == 1, "MANAGED_CATALOG").otherwise("SYSTEM_CATALOG")
    return part.select(_catalog().alias("catalog")).distinct().withColumn("catalog_type", kind)


def source_schemas(part: DataFrame) -> DataFrame:
    names = part.select(_catalog().alias("catalog"), _schema().alias("schema")).distinct()
    return names.withColumn("comment", F.concat(F.lit("schema "), "schema")).withColumn(
        "properties", F.create_map(F.lit("origin"), F.col("catalog"))
    )


def target_schemas(part: DataFrame) -> DataFrame:
    return source_schemas(part.filter((brand_number() % 5 != 0) | _system()))


def source_locations(region: DataFrame) -> DataFrame:
    key = F.col("r_regionkey")
    shallow = region.select(_text("loc_", key).alias("name"), _text("src://r", key).alias("url"))
    deep = region.select(
        _text("deep_", key).alias("name"), F.concat(_text("src://r", key), F.lit("/deep")).alias("url")
    )
    return shallow.unionByName(deep)


def target_locations(region: DataFrame) -> DataFrame:
    """The same names on the target; ``deep_4`` is missing there."""
    key = F.col("r_regionkey")
    shallow = region.select(_text("loc_", key).alias("name"), _text("dst://r", key).alias("url"))
    deep = region.filter(key != 4).select(
        _text("deep_", key).alias("name"), F.concat(_text("dst2://r", key), F.lit("/deep")).alias("url")
    )
    return shallow.unionByName(deep)


def part_locations(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source and target locations, two for each part; the target lacks every 13th part's."""
    key, root = F.col("p_partkey"), F.col("p_size") % 5
    near = part.select(key, _text("near_", key).alias("name"), F.concat(_text("src://r", root), F.lit("/"), key).alias("url"))
    deep = part.select(key, _text("far_", key).alias("name"), F.concat(_text("src://r", root), F.lit("/deep/"), key).alias("url"))
    both = near.unionByName(deep)
    moved = both.filter(key % 13 != 0).select("name", F.concat(F.lit("dst://"), "name").alias("url"))
    return both.select("name", "url"), moved


def _grants(lineitem: DataFrame, left_out: int) -> DataFrame:
    # Not made distinct: the comparison drops repeats in its own aggregate.
    return lineitem.filter(F.col("l_linenumber") % 3 != left_out).select(
        F.lit("TABLE").alias("securable_type"),
        _text("t_", "l_partkey").alias("full_name"),
        _text("u_", "l_suppkey").alias("principal"),
        F.concat("l_returnflag", "l_linestatus").alias("privilege"),
    )


def source_grants(lineitem: DataFrame) -> DataFrame:
    return _grants(lineitem, 2)


def target_grants(lineitem: DataFrame) -> DataFrame:
    return _grants(lineitem, 0)


def _part_securables(part: DataFrame) -> DataFrame:
    return part.select(
        F.lit("TABLE").alias("securable_type"), _text("t_", "p_partkey").alias("full_name")
    )


def source_securables(part: DataFrame) -> DataFrame:
    return _part_securables(part.filter(F.col("p_partkey") % 13 != 0))


def target_securables(part: DataFrame) -> DataFrame:
    return _part_securables(part.filter(F.col("p_partkey") % 10 != 0))


def direct_grants(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Grants on catalogs, schemas and tables of the inventory."""
    cats = catalogs(part).select(
        F.lit("CATALOG").alias("securable_type"),
        F.col("catalog").alias("full_name"),
        F.lit("admin").alias("principal"),
        F.lit("ALL").alias("privilege"),
    )
    even = part.filter((brand_number() % 2 == 0) & ~_system())
    schemas = even.select(
        F.lit("SCHEMA").alias("securable_type"),
        F.concat(_catalog(), F.lit("."), _schema()).alias("full_name"),
        _text("r_", brand_number() % 3).alias("principal"),
        F.lit("USE").alias("privilege"),
    ).distinct()
    names = part.select(
        F.col("p_partkey").alias("part"),
        F.concat(_catalog(), F.lit("."), _schema(), F.lit("."), _text("t_", "p_partkey")).alias("full_name"),
    )
    # The grants of ``source_grants``; their names are made up after the numbers were moved.
    given = lineitem.filter(F.col("l_linenumber") % 3 != 2).select(
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.concat("l_returnflag", "l_linestatus").alias("privilege"),
    )
    own = keyed_join(
        given.distinct(), names, ["part"], spread_by=["supplier", "privilege"], keys_of=given
    ).select(
        F.lit("TABLE").alias("securable_type"),
        "full_name",
        _text("u_", "supplier").alias("principal"),
        "privilege",
    )
    return cats.unionByName(schemas).unionByName(own)


def source_volumes(supplier: DataFrame, shift_owner: bool = False) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    owner = F.when(F.lit(shift_owner) & (key % 5 == 0), nation + 1).otherwise(nation)
    return supplier.select(
        F.lit("main").alias("catalog"),
        _text("s_", nation % 5).alias("schema"),
        _text("v_", key).alias("name"),
        F.when(key % 11 == 0, "MANAGED").otherwise("EXTERNAL").alias("volume_type"),
        _text("vol://v/", key).alias("storage_location"),
        _text("o_", owner).alias("owner"),
    )


def target_volumes(supplier: DataFrame) -> DataFrame:
    """Known on the target: two of three, some under another owner."""
    return source_volumes(supplier.filter(F.col("s_suppkey") % 3 != 0), shift_owner=True)
