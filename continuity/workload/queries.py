"""One query per operator, each over whole test tables.

A query that writes (files, tables, streams) does so in the shared folder and returns what
it reads back.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from continuity.functions import audit_columns, delay_type, qualified_name, quote
from continuity.operators import grants as G
from continuity.operators import listing as L
from continuity.operators.changes import apply_changes, row_changes
from continuity.operators.difference import differing_rows
from continuity.operators.locations import remap_locations
from continuity.operators.sampling import first_rows, top_n
from continuity.operators.volumes import registry_after, volume_upsert
from continuity.plans.clone import clone_by_name, clone_by_path
from continuity.plans.databases import create_schemas
from continuity.plans.ingest import ingest_flights, ingest_flights_stream
from continuity.plans.journal import Journal
from continuity.plans.replicate import replicate_named, replicate_path, run_clone_plan
from continuity.plans.retention import remove_unused
from continuity.plans.status import StatusLog, outcome
from continuity.plans.sync import SyncOptions, run_logged, run_sync
from continuity.plans.views import create_view, same_view, view_edges, view_levels, view_plan
from continuity.schemas import flight_schema
from continuity.sinks import append, append_once, batch_ledger
from continuity.sinks.ledger import create_table
from continuity.sources.pages import complete_listing, listing_gaps, read_pages
from continuity.sources.quarantine import append_split_stream, bad_lines, read_judged
from continuity.sources import live_inventory, read_batch, read_inventory, read_stream
from continuity.workload import inputs as I
from continuity.workload.inputs import load
from continuity.workspace import run_database, run_folder, run_id, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The test tables.
TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _source_table(path_column: str = "source_file"):
    """Name of the test table in a file path; the table may be one file or a folder."""
    return F.substring_index(F.substring_index(path_column, ".parquet", 1), "/", -1)


# ---- labels and audit columns ------------------------------------------------------------


@query
def flagship(spark, sf_dir):
    """Read, label and audit: the example ingest over all line items."""
    keys = ("l_orderkey", "l_linenumber")
    flights = I.flights(load(spark, sf_dir, "lineitem"), keep=(*keys, "_metadata"))
    labelled = flights.transform(delay_type).transform(audit_columns)
    return labelled.select(*keys, "delay_type", _source_table().alias("source_table"))


@query
def delay_type_labels(spark, sf_dir):
    return delay_type(I.flights(load(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))).select(
        "l_orderkey", "l_linenumber", "delay_type"
    )


@query
def delay_type_nulls(spark, sf_dir):
    """Rows whose last cause is null: the null is no cause and the next rule decides."""
    labelled = delay_type(I.flights(load(spark, sf_dir, "lineitem")))
    nulls = labelled.filter(F.col("LateAircraftDelay").isNull())
    return nulls.groupBy("delay_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def delay_type_carrier(spark, sf_dir):
    """The carrier cause is in no rule: such rows are uncategorized or unlabelled."""
    labelled = delay_type(I.flights(load(spark, sf_dir, "lineitem")))
    carrier = labelled.filter(F.col("CarrierDelay") != "NA")
    return carrier.groupBy("delay_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def audit_time(spark, sf_dir):
    stamped = audit_columns(load(spark, sf_dir, "orders"))
    age = F.unix_micros(F.current_timestamp()) - F.unix_micros("last_updated_time")
    return stamped.select("o_orderkey", age.between(0, 600_000_000).alias("is_recent"))


@query
def audit_date(spark, sf_dir):
    stamped = audit_columns(load(spark, sf_dir, "orders"), include_time=False)
    today = F.datediff(F.current_date(), "last_updated_date").between(0, 1)
    return stamped.select("o_orderkey", today.alias("is_recent"))


@query
def audit_source_file(spark, sf_dir):
    stamped = audit_columns(load(spark, sf_dir, "orders"))
    return stamped.select("o_orderkey", _source_table().alias("source_table"))


# ---- delimited files and sinks -----------------------------------------------------------


@query
def flight_schema_profile(spark, sf_dir):
    """Position, name, type and number of filled cells of each declared column."""
    schema = flight_schema()
    filled = I.flights(load(spark, sf_dir, "lineitem")).agg(
        *[F.count(F.col(name)).alias(name) for name in schema.names]
    )
    described = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(field.name).alias("name"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.col(field.name).alias("n_filled"),
        )
        for position, field in enumerate(schema.fields, start=1)
    ]
    return filled.select(F.inline(F.array(*described)))


_FLIGHT_FILES: dict[tuple[str, str], str] = {}
# Fixed value: a packed file cannot be split, so that many tasks find work there are many.
_LINES_PER_FILE = 100_000


def _flight_files(spark, sf_dir):
    """Folder with all line items as header-less flight files, packed, written once per session:
    the input of the file queries, not their work."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FLIGHT_FILES:
        folder = run_folder(spark, "flights")
        files = I.flights(load(spark, sf_dir, "lineitem"))
        files.write.option("maxRecordsPerFile", _LINES_PER_FILE).csv(folder, compression="gzip")
        _FLIGHT_FILES[key] = folder
    return _FLIGHT_FILES[key]


@query
def csv_declared_scan(spark, sf_dir):
    """All line items as header-less flight files, read back under the declared schema."""
    return read_batch(spark, _flight_files(spark, sf_dir))


def _odd_lines(spark, sf_dir):
    """Folder of flight lines of orders with a bad, short, long, empty or header-like shape."""
    key = F.col("o_orderkey")
    names = flight_schema().names
    cells = dict.fromkeys(names, F.lit("NA"))
    for position, name in enumerate(names):
        if flight_schema()[position].dataType.simpleString() == "int":
            cells[name] = F.lit("1")
    cells |= {
        "Year": F.year("o_orderdate").cast("string"),
        "UniqueCarrier": F.col("o_orderstatus"),
        "FlightNum": key.cast("string"),
        "IsDepDelayed": F.lit("YES"),
    }

    def line(changed=None, upto=None):
        values = cells | (changed or {})
        return F.concat_ws(",", *[values[n] for n in names[:upto]])

    shape = key % 6
    lines = (
        F.when(shape == 1, line({"Year": F.lit("x1999")}))
        .when(shape == 2, line(upto=10))
        .when(shape == 3, F.concat(line(), F.lit(",surplus,surplus")))
        .when(shape == 4, line({"WeatherDelay": F.lit("")}))
        .when(shape == 5, F.lit(",".join(names)))
        .otherwise(line())
    )
    folder = run_folder(spark, "lines")
    load(spark, sf_dir, "orders").select(lines.alias("value")).write.text(folder)
    return folder


@query
def csv_permissive(spark, sf_dir):
    """What a plain read makes of odd lines."""
    return delay_type(read_batch(spark, _odd_lines(spark, sf_dir))).select(
        "Year", "FlightNum", "UniqueCarrier", "WeatherDelay", "IsDepDelayed", "delay_type"
    )


@query
def csv_quarantine(spark, sf_dir):
    """The bad ones of the odd lines, with what is wrong."""
    judged = read_judged(spark, _odd_lines(spark, sf_dir))
    return bad_lines(judged).select("line", "reason", F.col("source_file").isNotNull().alias("has_file"))


@query
def stream_quarantine(spark, sf_dir):
    """Odd lines through a stream: the good rows by carrier, and how many lines went elsewhere."""
    database, folder = run_database(spark, "quarantine"), _odd_lines(spark, sf_dir)
    tables = quote(database, "flights"), quote(database, "bad_lines")
    checkpoint = run_folder(spark, "checkpoint")
    for _ in range(2):
        append_split_stream(spark, folder, *tables, checkpoint).awaitTermination()
    good, bad = (spark.table(t) for t in tables)
    kinds = bad.select(F.regexp_extract("reason", "^[^:]*", 0).alias("kind"))
    rows = good.select(F.concat(F.lit("good "), "UniqueCarrier").alias("kind")).unionByName(kinds)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def append_batch(spark, sf_dir):
    """Two appends of the orders: the second one adds the rows again."""
    table = quote(run_database(spark, "append"), "orders")
    orders = load(spark, sf_dir, "orders")
    append(orders, table)
    append(orders, table)
    return spark.table(table).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def append_contract(spark, sf_dir):
    """A second append with its columns in another order is matched by name."""
    table = quote(run_database(spark, "append"), "orders")
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )
    even = F.col("o_orderkey") % 2 == 0
    append(orders.filter(even), table)
    append(orders.filter(~even).select(*reversed(orders.columns)), table)
    return spark.table(table)


@query
def append_repeated(spark, sf_dir):
    """The orders of each status as a batch; each is stopped once half-way and given twice more."""
    table = quote(run_database(spark, "append"), "orders")
    orders = load(spark, sf_dir, "orders")
    for status in ("F", "O", "P"):
        batch = orders.filter(F.col("o_orderstatus") == status)
        bad = F.when(F.col("o_orderkey") % 100 == 1, F.raise_error(F.lit("stopped")))
        broken = batch.withColumn(
            "o_orderpriority", F.coalesce(bad.cast("string"), F.col("o_orderpriority"))
        )
        try:
            append_once(broken, table, "orders", status)
        except PySparkException:
            pass
        for _ in range(2):
            append_once(batch, table, "orders", status)
    told = batch_ledger(spark, table).select(F.col("batch").alias("o_orderstatus"), "rows")
    held = spark.table(table).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("o_orderkey").alias("n_orders")
    )
    return held.join(told, "o_orderstatus").withColumnRenamed("rows", "n_told")


@query
def stream_repeated(spark, sf_dir):
    """Events through a stream whose first run dies after its batch was appended: the second run
    is given the same batch again."""
    folder = run_folder(spark, "events")
    load(spark, sf_dir, "events").write.options(**EVENT_OPTIONS).csv(f"{folder}/files")
    table = quote(run_database(spark, "stream"), "events")

    def stream():
        return read_stream(spark, f"{folder}/files", EVENT_DDL, **EVENT_OPTIONS)

    create_table(stream(), table)

    def dies(batch, number):
        append_once(batch, table, "events", str(number))
        raise RuntimeError("stopped after the batch was appended")

    def take(batch, number):
        append_once(batch, table, "events", str(number))

    for work in (dies, take, take):
        writer = stream().writeStream.foreachBatch(work).trigger(availableNow=True)
        try:
            writer.option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
        except StreamingQueryException:
            pass
    spark.catalog.refreshTable(table)
    return spark.table(table)


EVENT_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
# Microseconds are kept, and quotes inside a cell are doubled.
EVENT_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "escape": '"'}


@query
def stream_ingest(spark, sf_dir):
    """Events as files into a table by a stream that runs twice; the second run adds nothing."""
    folder = run_folder(spark, "events")
    load(spark, sf_dir, "events").write.options(**EVENT_OPTIONS).csv(f"{folder}/files")
    table = quote(run_database(spark, "stream"), "events")
    for _ in range(2):
        stream = read_stream(spark, f"{folder}/files", EVENT_DDL, **EVENT_OPTIONS)
        append(stream, table, True, f"{folder}/checkpoint").awaitTermination()
    return spark.table(table)


@query
def stream_delay_type(spark, sf_dir):
    """Flight files through a stream with the same transforms as a batch."""
    files, checkpoint = _flight_files(spark, sf_dir), run_folder(spark, "checkpoint")
    table = quote(run_database(spark, "stream"), "flights")
    ingest_flights_stream(spark, files, table, checkpoint).awaitTermination()
    named = F.col("source_file").isNotNull() & F.col("last_updated_time").isNotNull()
    return (
        spark.table(table)
        .groupBy("UniqueCarrier", "delay_type")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(named, 1)).alias("n_audited"))
    )


@query
def ingest_flights_run(spark, sf_dir):
    """The example ingest from files to a named table, over every flight file."""
    table = quote(run_database(spark, "ingest"), "flights_raw")
    held = ingest_flights(spark, _flight_files(spark, sf_dir), table)
    return held.groupBy("Origin", "delay_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("last_updated_time").alias("n_audited")
    )


@query
def limit_count(spark, sf_dir):
    """Size of an unordered cut of 1,000 next to the size of the whole table."""
    orders = load(spark, sf_dir, "orders")
    cut = first_rows(orders, 1000).select(F.lit(1).alias("cut"), F.lit(0).alias("whole"))
    whole = orders.select(F.lit(0).alias("cut"), F.lit(1).alias("whole"))
    return cut.unionByName(whole).agg(
        F.sum("cut").alias("n_cut"), F.sum("whole").alias("n_whole")
    )


@query
def top_orders(spark, sf_dir):
    order = (F.desc("o_totalprice"), F.asc("o_orderkey"))
    return top_n(load(spark, sf_dir, "orders"), 1000, *order)


# ---- inventories -------------------------------------------------------------------------


def _inventory(spark, sf_dir):
    return I.tables(load(spark, sf_dir, "part"))


def _exported(spark, sf_dir):
    """An inventory as an export leaves it, read back."""
    part, folder = load(spark, sf_dir, "part"), run_folder(spark, "export")
    I.catalogs(part).write.parquet(f"{folder}/catalogs")
    I.source_schemas(part).write.parquet(f"{folder}/schemas")
    I.tables(part).write.parquet(f"{folder}/tables")
    return read_inventory(spark, folder)


@query
def inventory_catalogs(spark, sf_dir):
    return _exported(spark, sf_dir).catalogs


@query
def inventory_schemas(spark, sf_dir):
    schemas = _exported(spark, sf_dir).schemas
    return schemas.select("catalog", "schema", "comment", F.col("properties")["origin"].alias("origin"))


@query
def inventory_tables(spark, sf_dir):
    """Tables of every kind, enumerated over the listed schemas."""
    part = load(spark, sf_dir, "part")
    listed = L.in_schemas(L.user_tables(I.tables(part)), I.target_schemas(part))
    return listed.select("catalog", "schema", "name", "table_type", "owner")


@query
def inventory_external(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    chosen = L.copy_candidates(I.tables(part), I.catalogs(part), ["EXTERNAL"])
    return chosen.select("catalog", "schema", "name", "storage_location")


@query
def inventory_formats(spark, sf_dir):
    """External tables of one file format only."""
    part = load(spark, sf_dir, "part")
    chosen = L.copy_candidates(I.tables(part), I.catalogs(part), ["EXTERNAL"], formats=["delta"])
    return chosen.select("catalog", "schema", "name", "format")


@query
def inventory_views(spark, sf_dir):
    views = L.user_tables(_inventory(spark, sf_dir), "VIEW")
    return views.select("catalog", "schema", "name", "view_definition")


@query
def qualified_names(spark, sf_dir):
    tables = L.user_tables(_inventory(spark, sf_dir))
    return tables.select(qualified_name("catalog", "schema", "name").alias("full_name"))


@query
def schema_diff(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    missing = L.missing_schemas(I.source_schemas(part), I.target_schemas(part))
    return missing.select("catalog", "schema", "comment", F.col("properties")["origin"].alias("origin"))


@query
def schemas_created(spark, sf_dir):
    """Create the missing schemas; the database of each, read back from the catalog."""
    part = load(spark, sf_dir, "part")
    missing = L.missing_schemas(I.source_schemas(part), I.target_schemas(part))
    prefix, folder = f"continuity_{run_id()}", run_folder(spark, "schemas")
    log = StatusLog(spark)
    create_schemas(
        spark,
        missing,
        log,
        lambda catalog, schema: f"{prefix}__{catalog}__{schema}",
        lambda row: f"{folder}/{row.catalog}/{row.schema}",
    )
    listed = spark.sql(f"SHOW DATABASES LIKE '{prefix}__*'")
    name = F.split(F.lower("namespace"), "__")
    found = listed.select(name[1].alias("catalog"), name[2].alias("schema"), F.lit(True).alias("found"))
    return (
        log.frame()
        .join(found, ["catalog", "schema"], "left")
        .select("catalog", "schema", "kind", "status", F.coalesce("found", F.lit(False)).alias("found"))
    )


@query
def schema_orphans(spark, sf_dir):
    """Report of target tables whose schema the source no longer lists (sides swapped)."""
    part = load(spark, sf_dir, "part")
    orphans = L.only_in_target(I.target_schemas(part), I.source_schemas(part), ["catalog", "schema"])
    return orphans.select("catalog", "schema")


@query
def shared_schemas(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return L.schemas_of(L.copy_candidates(I.tables(part), I.catalogs(part), ["EXTERNAL"]))


@query
def location_remap(spark, sf_dir):
    part, region = load(spark, sf_dir, "part"), load(spark, sf_dir, "region")
    chosen = L.copy_candidates(I.tables(part), I.catalogs(part), ["EXTERNAL"])
    moved = remap_locations(chosen, I.source_locations(region), I.target_locations(region))
    return moved.select(
        "catalog", "schema", "name", "storage_location", "location_name", "target_location", "problem"
    )


@query
def location_remap_many(spark, sf_dir):
    """Two locations for each part, and tables whose names repeat and whose schemas may be null."""
    part = load(spark, sf_dir, "part")
    tables = I.tables(part).withColumns(
        {
            "schema": F.when(F.length("storage_location") % 3 > 0, F.col("schema")),
            "name": F.substring("name", 1, 4),
        }
    )
    source, target = I.part_locations(part)
    moved = remap_locations(tables, source, target)
    return moved.select(
        "catalog", "schema", "name", "storage_location", "location_name", "target_location", "problem"
    )


@query
def clone_plan(spark, sf_dir):
    """What a run would copy: managed tables by name, external ones by path."""
    part, region = load(spark, sf_dir, "part"), load(spark, sf_dir, "region")
    tables, catalogs = I.tables(part), I.catalogs(part)
    named = clone_by_name(L.copy_candidates(tables, catalogs, ["MANAGED"]))
    by_path = clone_by_path(
        L.copy_candidates(tables, catalogs, ["EXTERNAL"]),
        I.source_locations(region),
        I.target_locations(region),
    )
    return named.unionByName(by_path)


@query
def view_plans(spark, sf_dir):
    return view_plan(_inventory(spark, sf_dir))


@query
def volume_upserts(spark, sf_dir):
    supplier = load(spark, sf_dir, "supplier")
    return volume_upsert(I.source_volumes(supplier), I.target_volumes(supplier))


@query
def volume_registry_after(spark, sf_dir):
    supplier = load(spark, sf_dir, "supplier")
    return registry_after(I.source_volumes(supplier), I.target_volumes(supplier))


# ---- grants ------------------------------------------------------------------------------


def _grant_sides(spark, sf_dir):
    lineitem, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    sides = I.source_grants(lineitem), I.target_grants(lineitem)
    return sides, (I.source_securables(part), I.target_securables(part))


def _diff(spark, sf_dir):
    sides, objects = _grant_sides(spark, sf_dir)
    return G.grant_diff(*sides, objects)


def _changes(spark, sf_dir):
    joined = {side: F.concat_ws(",", side) for side in ("add", "remove")}
    return G.grant_changes(_diff(spark, sf_dir)).withColumns(joined)


@query
def grant_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query
def grant_adds(spark, sf_dir):
    return G.grant_adds(_diff(spark, sf_dir))


@query
def grant_removes(spark, sf_dir):
    return G.grant_removes(_diff(spark, sf_dir))


@query
def grant_principals(spark, sf_dir):
    sides, objects = _grant_sides(spark, sf_dir)
    return G.grant_principals(*sides, objects)


@query
def grant_changes(spark, sf_dir):
    return _changes(spark, sf_dir).drop("change_kind")


@query
def grant_change_kind(spark, sf_dir):
    return _changes(spark, sf_dir).select("full_name", "principal", "change_kind")


@query
def grant_status(spark, sf_dir):
    sides, objects = _grant_sides(spark, sf_dir)
    return G.grant_status(G.grant_diff(*sides), *objects)


@query
def grant_not_found(spark, sf_dir):
    _, objects = _grant_sides(spark, sf_dir)
    return G.not_found(*objects)


@query
def grants_after(spark, sf_dir):
    sides, objects = _grant_sides(spark, sf_dir)
    return G.grants_after(*sides, objects)


@query
def effective_grants(spark, sf_dir):
    return _effective(spark, sf_dir)[1]


def _effective(spark, sf_dir):
    """The objects and their effective grants; the direct ones are made up once."""
    part, lineitem = load(spark, sf_dir, "part"), load(spark, sf_dir, "lineitem")
    objects, direct = _objects(part), stored(I.direct_grants(part, lineitem), "direct_grants")
    return objects, G.effective_grants(objects, direct)


def _objects(part):
    return L.securables(I.catalogs(part), I.source_schemas(part), I.tables(part))


@query
def least_grants(spark, sf_dir):
    """The smallest set of direct grants with the effective grants of the inventory."""
    return G.least_grants(*_effective(spark, sf_dir))


@query
def grant_placement(spark, sf_dir):
    """Where effective grants have to be given when some tables are not to have what their
    schema hands down."""
    objects, effective = _effective(spark, sf_dir)
    key = F.substring_index("full_name", "_", -1).cast("bigint")
    table = (F.col("securable_type") == "TABLE") & (F.col("privilege") == "USE")
    kept = effective.filter(~F.when(table, key % 40 == 1).otherwise(False))
    return G.grant_placement(objects, kept)


# ---- copies ------------------------------------------------------------------------------


def _register(spark, sf_dir, database, table):
    """Name a test table without copying it."""
    path = f"{sf_dir}/{table}.parquet"
    spark.sql(f"CREATE TABLE {quote(database, table)} USING parquet LOCATION '{path}'")
    return quote(database, table)


@query
def replicate_table(spark, sf_dir):
    """Full copy of a table by name, twice: the second version replaces the first."""
    source = _register(spark, sf_dir, run_database(spark, "source"), "orders")
    target = quote(run_database(spark, "target"), "orders")
    folder = run_folder(spark, "orders")
    for _ in range(2):
        replicate_named(spark, source, target, folder)
    return spark.table(target)


@query
def replicate_partitioned(spark, sf_dir):
    """Full copy of a table partitioned by order status; the layout is kept."""
    database = run_database(spark, "source")
    source, target = quote(database, "orders"), quote(run_database(spark, "target"), "orders")
    orders = load(spark, sf_dir, "orders")
    orders.write.partitionBy("o_orderstatus").saveAsTable(source)
    replicate_named(spark, source, target, run_folder(spark, "orders"))
    return spark.table(target).select(*orders.columns)


def _changing_orders(spark, sf_dir):
    """Three copies of the orders by year and status. Between the first and the second, one
    partition changes, one goes and one comes; nothing happens before the third."""
    source = quote(run_database(spark, "source"), "orders")
    target = quote(run_database(spark, "target"), "orders")
    folder = run_folder(spark, "orders")
    orders = load(spark, sf_dir, "orders").withColumn("o_year", F.year("o_orderdate"))
    orders.write.partitionBy("o_year", "o_orderstatus").saveAsTable(source)

    def copy():
        return replicate_named(spark, source, target, folder, skip_unchanged=True)

    copies = [copy()]
    for gone in ("1997", "1995"):
        status = "F" if gone == "1997" else "P"
        spark.sql(f"ALTER TABLE {source} DROP PARTITION (o_year = {gone}, o_orderstatus = '{status}')")
    raised = orders.filter("o_year = 1997 AND o_orderstatus = 'F'").withColumn(
        "o_totalprice", F.col("o_totalprice") + 1
    )
    moved = orders.filter("o_year = 1996 AND o_orderstatus = 'O'").withColumns(
        {"o_orderkey": -F.col("o_orderkey"), "o_year": F.lit(2030)}
    )
    columns = spark.table(source).columns
    for added in (raised, moved):
        added.select(columns).write.mode("append").insertInto(source)
    copies += [copy(), copy()]
    return target, copies, folder


@query
def replicate_changed(spark, sf_dir):
    """What a copy by changed partitions holds after its source changed."""
    target, *_ = _changing_orders(spark, sf_dir)
    return spark.table(target)


@query
def replicate_changed_work(spark, sf_dir):
    """Rows and partitions that each of the three copies moved, kept and dropped."""
    _, copies, _ = _changing_orders(spark, sf_dir)
    rows = [(run, c.rows, c.written, c.kept, c.dropped) for run, c in enumerate(copies, start=1)]
    return spark.createDataFrame(
        rows, "run bigint, n_rows bigint, n_written bigint, n_kept bigint, n_dropped bigint"
    )


@query
def replicate_external(spark, sf_dir):
    """Full copy of a table by path to a path of the target."""
    target = quote(run_database(spark, "target"), "lineitem")
    path = f"{sf_dir}/lineitem.parquet"
    replicate_path(spark, path, target, run_folder(spark, "lineitem"))
    return spark.table(target)


@query
def locate_differences(spark, sf_dir):
    """The rows in which a copy of the orders differs: some changed, some lost, some doubled."""
    orders = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    price = F.when(key % 97 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = orders.filter(key % 101 != 7).withColumn("o_totalprice", price)
    copy = stored(kept.unionByName(orders.filter(key % 103 == 3)), "spoilt_copy")
    return differing_rows(orders, copy)


@query
def retention(spark, sf_dir):
    """A copy whose partitions lie in two versions, after everything unused was removed."""
    target, _, folder = _changing_orders(spark, sf_dir)
    database = target.split("`")[1]
    remove_unused(spark, folder, [database], datetime.timedelta(0), dry_run=False)
    spark.catalog.refreshTable(target)
    return spark.table(target)


def _listing_pages(spark, sf_dir, part="tables"):
    """The tables, by schema and owner, as listing pages of at most five, written and read again.
    A page's token is its number; the listing of a schema begins with the page without one."""
    parts = load(spark, sf_dir, "part")
    place = ["catalog", "schema"]
    listed = I.tables(parts).withColumns(
        {
            "catalog": F.col("schema"),
            "schema": F.col("owner"),
            "page": F.floor(F.substring("name", 3, 20).cast("bigint") / 5),
        }
    )
    item = F.struct(*[c for c in listed.columns if c not in (*place, "page")])
    pages = listed.groupBy(*place, "page").agg(F.collect_list(item).alias("items"))
    order = Window.partitionBy(*place).orderBy("page")
    first = F.row_number().over(order) == 1
    written = pages.select(
        *place,
        F.when(~first, F.col("page").cast("string")).alias("page_token"),
        F.lead(F.col("page").cast("string")).over(order).alias("next_page_token"),
        "items",
    )
    folder = run_folder(spark, "listing")
    written.repartition("catalog").write.partitionBy("catalog").json(f"{folder}/{part}")
    return read_pages(spark, folder, part)


@query
def listing_pages(spark, sf_dir):
    """The table inventory from its listing pages, some of them fetched twice."""
    pages = _listing_pages(spark, sf_dir)
    again = pages.filter("page_token LIKE '%1'")
    found, _ = complete_listing(pages.unionByName(again))
    return found


@query
def listing_gaps_found(spark, sf_dir):
    """What is wrong when pages are lost."""
    pages = _listing_pages(spark, sf_dir)
    return listing_gaps(pages.filter("page_token IS NULL OR page_token % 5 <> 2"))


def _order_versions(spark, sf_dir):
    """The orders and a later version: some changed, some gone, some under a new key."""
    orders = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    price = F.when(key % 89 == 4, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = orders.filter(key % 101 != 7).withColumn("o_totalprice", price)
    new = orders.filter(key % 103 == 3).withColumn("o_orderkey", -key)
    return orders, stored(kept.unionByName(new), "later_version")


@query
def row_changes_between(spark, sf_dir):
    """Inserts, deletes and updates of orders between two versions, by order key."""
    before, after = _order_versions(spark, sf_dir)
    return row_changes(before, after, ["o_orderkey"])


@query
def row_changes_applied(spark, sf_dir):
    """A third copy, which lacks the orders of one status, after the changes."""
    before, after = _order_versions(spark, sf_dir)
    changes = stored(row_changes(before, after, ["o_orderkey"]), "changes")
    return apply_changes(before.filter("o_orderstatus <> 'P'"), changes)


@query
def view_order(spark, sf_dir):
    """Levels of views that read each other in chains of five, one per supplier; in every fourth
    chain the first reads the third, if there is one."""
    key, place = F.col("s_suppkey"), F.col("s_suppkey") % 5
    chain = F.floor(key / 5)
    read = F.when(place > 0, key - 1).when(chain % 4 == 3, key + 2)
    views = load(spark, sf_dir, "supplier").select(
        F.lit("main").alias("catalog"),
        F.lit("s").alias("schema"),
        F.concat(F.lit("v_"), key).alias("view"),
        F.when(read.isNull(), "SELECT * FROM base")
        .otherwise(F.concat(F.lit("SELECT * FROM s.v_"), read.cast("string"), F.lit(" WHERE k > 0")))
        .alias("view_definition"),
    )
    edges = view_edges(
        spark, views, lambda r: quote(r.schema, r.view), lambda r: r.view_definition, lambda r: quote(r.schema)
    )
    return view_levels(edges).select(F.col("row.view").alias("view"), "level", "problem")


@query
def replicate_view(spark, sf_dir):
    """A view over a table and its replica over the table's copy, with a check of both."""
    source, target = run_database(spark, "source"), run_database(spark, "target")
    base = _register(spark, sf_dir, source, "orders")
    copy = quote(target, "orders")
    replicate_named(spark, base, copy, run_folder(spark, "orders"))
    definition = (
        "SELECT o_orderpriority, count(*) AS n_orders, max(o_totalprice) AS top_price "
        "FROM {} GROUP BY o_orderpriority"
    )
    views = quote(source, "priorities"), quote(target, "priorities")
    for view, table in zip(views, (base, copy)):
        create_view(spark, view, definition.format(table))
    return spark.table(views[1]).withColumn("same", F.lit(same_view(spark, *views)))


@query
def sync_status(spark, sf_dir):
    """Copies of three tables and two rows that must fail, with what is readable after."""
    source, target = run_database(spark, "source"), run_database(spark, "target")
    names = ("orders", "lineitem", "part")
    for name in names:
        _register(spark, sf_dir, source, name)
    folder = run_folder(spark, "sync")
    columns = "catalog string, schema string, table string, kind string, source string, "
    columns += "target string, format string, source_location string, target_location string, problem string"
    rows = [("main", "sales", n, "name", n, n, "parquet", None, None, None) for n in (*names, "absent")]
    rows.append(("main", "sales", "homeless", "path", None, None, "parquet", "x://y", None, "no location"))
    log = StatusLog(spark)
    run_clone_plan(
        spark,
        spark.createDataFrame(rows, columns),
        log,
        source_of=lambda r: quote(source, r.source),
        target_of=lambda r: quote(target, r.table),
        folder_of=lambda r: f"{folder}/{r.table}",
    )
    counts = None
    for name in names:
        one = spark.table(quote(target, name)).agg(F.count(F.lit(1)).alias("n_rows"))
        one = one.withColumn("table", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return (
        log.frame()
        .join(counts, "table", "left")
        .select("catalog", "schema", "table", "kind", outcome().alias("status"), "n_rows")
    )


def _count(df, kind, name):
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(kind).alias("kind"), F.lit(name).alias("object"), "n_rows"
    )


def _sync_case(spark, sf_dir, run):
    """A whole run over all test tables, done by ``run``: every status, and what the target holds
    after; and the folder of the copies, with the target's name."""
    source, target = run_database(spark, "source"), run_database(spark, "target")
    for name in TEST_TABLES:
        _register(spark, sf_dir, source, name)
    orders, supplier = load(spark, sf_dir, "orders"), load(spark, sf_dir, "supplier")
    create_view(
        spark,
        quote(source, "busy_customers"),
        f"SELECT o_custkey, count(*) AS n FROM {quote(source, 'orders')} GROUP BY o_custkey",
    )
    granted = orders.select(
        F.lit("TABLE").alias("securable_type"),
        F.lit(f"spark_catalog.{source}.orders").alias("full_name"),
        F.col("o_orderpriority").alias("principal"),
        F.col("o_orderstatus").alias("privilege"),
    )
    theirs = live_inventory(spark, [target])
    homes = I.source_volumes(supplier).select("catalog", "schema").distinct()
    homes = homes.select("*", F.lit(None).cast("string").alias("comment"), F.create_map().cast("map<string,string>").alias("properties"))
    theirs = replace(
        theirs,
        schemas=theirs.schemas.unionByName(homes),
        volumes=I.target_volumes(supplier),
        # Listed, and nothing is granted yet.
        grants=granted.limit(0),
    )
    folder = run_folder(spark, "replica")
    result = run(
        spark,
        replace(
            live_inventory(spark, [source]), volumes=I.source_volumes(supplier), grants=granted
        ),
        theirs,
        SyncOptions(
            source_database=lambda catalog, schema: schema,
            target_database=lambda catalog, schema: target,
            folder=folder,
            named_types=("EXTERNAL",),
            path_types=(),
            view_definition=lambda row: row.view_definition.replace(source, target),
        ),
    )
    held = _count(result.volumes, "volumes", "after").unionByName(
        _count(result.grants, "grants", "after")
    )
    for name in (*TEST_TABLES, "busy_customers"):
        held = held.unionByName(_count(spark.table(quote(target, name)), "rows", name))
    named = F.col("kind").isin("table_by_name", "view")
    statuses = result.status.filter("status is not null").groupBy(
        "kind", F.when(named, F.col("table")).otherwise("all").alias("object"), outcome().alias("status")
    ).agg(F.count(F.lit(1)).alias("n_rows"))
    done = statuses.unionByName(held.withColumn("status", F.lit("held")))
    return done, f"{folder}/tables/spark_catalog/{source}"


@query
def sync_run(spark, sf_dir):
    """A whole run over all test tables: every status, and what the target holds after."""
    return _sync_case(spark, sf_dir, run_sync)[0]


class _Stopped(BaseException):
    pass


class _StoppingJournal(Journal):
    """A journal whose run is stopped after some objects were finished."""

    left = 4

    def add(self, status):
        super().add(status)
        self.left -= 1
        if self.left == 0:
            raise _Stopped


@query
def sync_resumed(spark, sf_dir):
    """The whole run, stopped again and again and gone on with from its journal. Every row of
    every version folder is counted, so a table that was copied twice would show."""

    def stopped(spark, ours, theirs, options):
        folder = run_folder(spark, "journal")
        while True:
            try:
                return run_logged(spark, ours, theirs, options, _StoppingJournal(spark, folder))
            except _Stopped:
                pass

    done, copies = _sync_case(spark, sf_dir, stopped)
    for name in TEST_TABLES:
        written = spark.read.option("recursiveFileLookup", True).parquet(f"{copies}/{name}")
        done = done.unionByName(_count(written, "written", name).withColumn("status", F.lit("held")))
    return done
