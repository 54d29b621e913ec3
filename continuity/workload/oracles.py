"""The same results in SQL, over the test tables as views."""

from __future__ import annotations

from continuity.workload import inputs_sql as Q

# The declared columns and types of a flight file, in order.
_INT_COLUMNS = (
    "Year", "Month", "DayofMonth", "DayOfWeek", "CRSDepTime", "CRSArrTime", "FlightNum",
    "CRSElapsedTime", "Cancelled", "Diverted",
)
_COLUMNS = (
    "Year", "Month", "DayofMonth", "DayOfWeek", "DepTime", "CRSDepTime", "ArrTime", "CRSArrTime",
    "UniqueCarrier", "FlightNum", "TailNum", "ActualElapsedTime", "CRSElapsedTime", "AirTime",
    "ArrDelay", "DepDelay", "Origin", "Dest", "Distance", "TaxiIn", "TaxiOut", "Cancelled",
    "CancellationCode", "Diverted", "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay",
    "LateAircraftDelay", "IsArrDelayed", "IsDepDelayed",
)
_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _profile() -> str:
    rows = [
        f"SELECT {i} AS position, '{name}' AS name, "
        f"'{'int' if name in _INT_COLUMNS else 'string'}' AS type, "
        f'count("{name}") AS n_filled FROM flights'
        for i, name in enumerate(_COLUMNS, start=1)
    ]
    return f"WITH {Q.FLIGHTS} " + " UNION ALL ".join(rows)


def _permissive() -> str:
    shapes = """
      SELECT o_orderkey % 6 AS shape, CAST(year(o_orderdate) AS INTEGER) AS y,
        CAST(o_orderkey AS INTEGER) AS k, o_orderstatus AS s FROM orders"""
    return f"""WITH shaped AS ({shapes}), cells AS (
      SELECT CASE WHEN shape IN (1, 5) THEN NULL ELSE y END AS "Year",
        CASE WHEN shape = 5 THEN NULL ELSE k END AS "FlightNum",
        CASE WHEN shape = 5 THEN 'UniqueCarrier' ELSE s END AS "UniqueCarrier",
        CASE WHEN shape IN (2, 4) THEN NULL WHEN shape = 5 THEN 'WeatherDelay' ELSE 'NA' END
          AS "WeatherDelay",
        CASE WHEN shape = 2 THEN NULL WHEN shape = 5 THEN 'IsDepDelayed' ELSE 'YES' END
          AS "IsDepDelayed"
      FROM shaped)
    SELECT *, CASE WHEN "WeatherDelay" = 'WeatherDelay' THEN 'WeatherDelay'
      WHEN "IsDepDelayed" = 'YES' THEN 'UncategorizedDelay' END AS delay_type FROM cells"""


def _odd_lines() -> str:
    """The odd lines (shape, line) and, of the bad ones, the reason."""

    def cell(name: str) -> str:
        return {
            "Year": "y", "UniqueCarrier": "s", "FlightNum": "k", "IsDepDelayed": "'YES'"
        }.get(name, "'1'" if name in _INT_COLUMNS else "'NA'")

    def line(names: tuple[str, ...] = _COLUMNS, **changed: str) -> str:
        return "concat_ws(',', " + ", ".join(changed.get(n, cell(n)) for n in names) + ")"

    header = "; ".join(f"{n}: ''{n}'' is no int" for n in _COLUMNS if n in _INT_COLUMNS)
    return f"""odd AS (
      SELECT o_orderkey % 6 AS shape, CAST(year(o_orderdate) AS VARCHAR) AS y,
        CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s FROM orders),
    lines AS (
      SELECT shape, s, CASE shape WHEN 1 THEN {line(Year="'x1999'")} WHEN 2 THEN {line(_COLUMNS[:10])}
        WHEN 3 THEN concat({line()}, ',surplus,surplus') WHEN 5 THEN '{",".join(_COLUMNS)}' END AS line,
        CASE shape WHEN 1 THEN 'Year: ''x1999'' is no int' WHEN 2 THEN 'too few cells: 10 of 31'
          WHEN 3 THEN 'too many cells: 33 of 31' WHEN 5 THEN '{header}' END AS reason
      FROM odd)"""


_SYNC_STATUS = """
SELECT 'main' AS catalog, 'sales' AS schema, 'orders' AS "table", 'table_by_name' AS kind,
  'SUCCESS' AS status, count(*) AS n_rows FROM orders
UNION ALL SELECT 'main', 'sales', 'lineitem', 'table_by_name', 'SUCCESS', count(*) FROM lineitem
UNION ALL SELECT 'main', 'sales', 'part', 'table_by_name', 'SUCCESS', count(*) FROM part
UNION ALL SELECT 'main', 'sales', 'absent', 'table_by_name', 'FAIL', NULL
UNION ALL SELECT 'main', 'sales', 'homeless', 'table_by_path', 'FAIL', NULL"""


def _sync_run() -> str:
    copied = [
        f"UNION ALL SELECT 'table_by_name', '{t}', 'SUCCESS', 1 "
        f"UNION ALL SELECT 'rows', '{t}', 'held', count(*) FROM {t}"
        for t in _TABLES
    ]
    return f"""WITH {Q.VOLUMES},
    ext AS (SELECT * FROM src_vol WHERE volume_type = 'EXTERNAL'),
    known AS (SELECT name FROM tgt_vol)
    SELECT 'schema' AS kind, 'all' AS object, 'SUCCESS' AS status, 1 AS n_rows
    UNION ALL SELECT 'view', 'busy_customers', 'SUCCESS', 1
    UNION ALL SELECT 'rows', 'busy_customers', 'held', count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'volume', 'all', 'success', count(*) FROM ext
      WHERE name NOT IN (SELECT name FROM known)
    UNION ALL SELECT 'volume', 'all', 'already_exists', count(*) FROM ext
      WHERE name IN (SELECT name FROM known)
    UNION ALL SELECT 'volumes', 'after', 'held', count(*) FROM (
      SELECT name FROM ext UNION SELECT name FROM known)
    UNION ALL SELECT 'grants_table', 'all', 'SUCCESS', 1
    UNION ALL SELECT 'grants_volume', 'all', 'NotFound', count(*) FROM src_vol
      WHERE volume_type <> 'EXTERNAL' AND name NOT IN (SELECT name FROM known)
      HAVING count(*) > 0
    UNION ALL SELECT 'grants', 'after', 'held', count(*) FROM (
      SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders)
    {" ".join(copied)}"""


_USER = "schema <> 'information_schema'"
_MANAGED = "catalog IN (SELECT catalog FROM cats WHERE catalog_type = 'MANAGED_CATALOG')"

ORACLES: dict[str, str] = {
    "flagship": f"""WITH {Q.FLIGHTS}
        SELECT l_orderkey, l_linenumber, {Q.DELAY_TYPE} AS delay_type,
          'lineitem' AS source_table FROM flights""",
    "delay_type_labels": f"""WITH {Q.FLIGHTS}
        SELECT l_orderkey, l_linenumber, {Q.DELAY_TYPE} AS delay_type FROM flights""",
    "delay_type_nulls": f"""WITH {Q.FLIGHTS}
        SELECT {Q.DELAY_TYPE} AS delay_type, count(*) AS n_rows FROM flights
        WHERE "LateAircraftDelay" IS NULL GROUP BY 1""",
    "delay_type_carrier": f"""WITH {Q.FLIGHTS}
        SELECT {Q.DELAY_TYPE} AS delay_type, count(*) AS n_rows FROM flights
        WHERE "CarrierDelay" <> 'NA' GROUP BY 1""",
    "audit_time": "SELECT o_orderkey, TRUE AS is_recent FROM orders",
    "audit_date": "SELECT o_orderkey, TRUE AS is_recent FROM orders",
    "audit_source_file": "SELECT o_orderkey, 'orders' AS source_table FROM orders",
    "flight_schema_profile": _profile(),
    "csv_declared_scan": f"""WITH {Q.FLIGHTS}
        SELECT {", ".join(f'"{c}"' for c in _COLUMNS)} FROM flights""",
    "csv_permissive": _permissive(),
    "csv_quarantine": f"""WITH {_odd_lines()}
        SELECT line, reason, TRUE AS has_file FROM lines WHERE reason IS NOT NULL""",
    "stream_quarantine": f"""WITH {_odd_lines()}
        SELECT coalesce(regexp_extract(reason, '^[^:]*'), concat('good ', s)) AS kind,
          count(*) AS n_lines FROM lines GROUP BY 1""",
    "append_batch": """SELECT o_orderstatus, 2 * count(*) AS n_rows FROM orders
        GROUP BY o_orderstatus""",
    "append_repeated": """SELECT o_orderstatus, count(*) AS n_rows,
        count(DISTINCT o_orderkey) AS n_orders, count(*) AS n_told
        FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY o_orderstatus""",
    "stream_repeated": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "append_contract": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "stream_ingest": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "stream_delay_type": f"""WITH {Q.FLIGHTS}
        SELECT "UniqueCarrier", {Q.DELAY_TYPE} AS delay_type, count(*) AS n_rows,
          count(*) AS n_audited FROM flights GROUP BY 1, 2""",
    "ingest_flights_run": f"""WITH {Q.FLIGHTS}
        SELECT "Origin", {Q.DELAY_TYPE} AS delay_type, count(*) AS n_rows,
          count(*) AS n_audited FROM flights GROUP BY 1, 2""",
    "limit_count": """SELECT least(count(*), 1000) AS n_cut, count(*) AS n_whole FROM orders""",
    "top_orders": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000",
    "inventory_catalogs": f"WITH {Q.CATALOGS} SELECT * FROM cats",
    "inventory_schemas": f"""WITH {Q.SCHEMAS}
        SELECT catalog, schema, concat('schema ', schema) AS comment, catalog AS origin
        FROM src_schemas""",
    "inventory_tables": f"""WITH {Q.TABLES}, {Q.SCHEMAS}
        SELECT catalog, schema, name, table_type, owner FROM inv
        JOIN tgt_schemas USING (catalog, schema) WHERE {_USER}""",
    "inventory_external": f"""WITH {Q.TABLES}, {Q.CATALOGS}
        SELECT catalog, schema, name, storage_location FROM inv
        WHERE {_USER} AND table_type = 'EXTERNAL' AND {_MANAGED}""",
    "inventory_formats": f"""WITH {Q.TABLES}, {Q.CATALOGS}
        SELECT catalog, schema, name, format FROM inv
        WHERE {_USER} AND table_type = 'EXTERNAL' AND format = 'delta' AND {_MANAGED}""",
    "inventory_views": f"""WITH {Q.TABLES}
        SELECT catalog, schema, name, view_definition FROM inv
        WHERE {_USER} AND table_type = 'VIEW'""",
    "qualified_names": f"""WITH {Q.TABLES}
        SELECT concat(catalog, '.', schema, '.', name) AS full_name FROM inv WHERE {_USER}""",
    "schema_diff": f"""WITH {Q.SCHEMAS}
        SELECT catalog, schema, concat('schema ', schema) AS comment, catalog AS origin
        FROM src_schemas s WHERE NOT EXISTS (
          SELECT 1 FROM tgt_schemas t WHERE t.catalog = s.catalog AND t.schema = s.schema)""",
    "schemas_created": f"""WITH {Q.SCHEMAS}
        SELECT catalog, schema, 'schema' AS kind, 'SUCCESS' AS status, TRUE AS found
        FROM src_schemas s WHERE NOT EXISTS (
          SELECT 1 FROM tgt_schemas t WHERE t.catalog = s.catalog AND t.schema = s.schema)""",
    "schema_orphans": f"""WITH {Q.SCHEMAS}
        SELECT catalog, schema FROM src_schemas EXCEPT SELECT catalog, schema FROM tgt_schemas""",
    "shared_schemas": f"""WITH {Q.TABLES}, {Q.CATALOGS}
        SELECT DISTINCT catalog, schema FROM inv
        WHERE {_USER} AND table_type = 'EXTERNAL' AND {_MANAGED}""",
    "location_remap": f"""WITH {Q.REMAPPED}
        SELECT catalog, schema, name, storage_location, location_name, target_location, problem
        FROM remapped""",
    "location_remap_many": f"""WITH {Q.TABLES},
        many AS (
          SELECT catalog, CASE WHEN length(storage_location) % 3 > 0 THEN schema END AS schema,
            substr(name, 1, 4) AS name, storage_location FROM inv),
        places AS (
          SELECT p_partkey, concat(kind, '_', p_partkey) AS label,
            concat('src://r', p_size % 5, CASE kind WHEN 'far' THEN '/deep' ELSE '' END, '/', p_partkey) AS url
          FROM part, (VALUES ('near'), ('far')) AS k(kind))
        SELECT catalog, schema, name, storage_location, label AS location_name,
          CASE WHEN p_partkey % 13 <> 0 THEN concat('dst://', label, substr(storage_location, length(url) + 1)) END
            AS target_location,
          CASE WHEN url IS NULL THEN 'no location' WHEN p_partkey % 13 = 0 THEN 'no target location' END AS problem
        FROM many LEFT JOIN places ON storage_location = url""",
    "clone_plan": f"""WITH {Q.REMAPPED}
        SELECT catalog, schema, name AS "table", 'name' AS kind,
          concat(catalog, '_share.', schema, '.', name) AS source,
          concat(catalog, '.', schema, '.', name) AS target, format,
          CAST(NULL AS VARCHAR) AS source_location, CAST(NULL AS VARCHAR) AS target_location,
          CAST(NULL AS VARCHAR) AS problem
        FROM inv WHERE {_USER} AND table_type = 'MANAGED' AND {_MANAGED}
        UNION ALL
        SELECT catalog, schema, name, 'path', concat(format, '.`', storage_location, '`'),
          concat(catalog, '.', schema, '.', name), format, storage_location, target_location,
          problem FROM remapped""",
    "view_plans": f"""WITH {Q.TABLES}
        SELECT catalog, schema, name AS "view", concat(catalog, '.', schema, '.', name) AS target,
          view_definition FROM inv WHERE {_USER} AND table_type = 'VIEW'""",
    "volume_upserts": f"""WITH {Q.VOLUMES}
        SELECT s.catalog, s.schema, s.name,
          concat(s.catalog, '.', s.schema, '.', s.name) AS full_name, s.storage_location, s.owner,
          CASE WHEN t.name IS NULL THEN 'success' ELSE 'already_exists' END AS status,
          t.name IS NOT NULL AND t.owner <> s.owner AS owner_changed
        FROM src_vol s LEFT JOIN tgt_vol t
          ON t.catalog = s.catalog AND t.schema = s.schema AND t.name = s.name
        WHERE s.volume_type = 'EXTERNAL'""",
    "volume_registry_after": f"""WITH {Q.VOLUMES},
        ext AS (SELECT * FROM src_vol WHERE volume_type = 'EXTERNAL')
        SELECT t.catalog, t.schema, t.name, t.volume_type, t.storage_location,
          coalesce(e.owner, t.owner) AS owner
        FROM tgt_vol t LEFT JOIN ext e
          ON t.catalog = e.catalog AND t.schema = e.schema AND t.name = e.name
        UNION ALL
        SELECT * FROM ext WHERE name NOT IN (SELECT name FROM tgt_vol)""",
    "grant_diff": f"WITH {Q.DIFF} SELECT * FROM diff",
    "grant_adds": f"""WITH {Q.DIFF} SELECT securable_type, full_name, principal, privilege
        FROM diff WHERE change = 'add'""",
    "grant_removes": f"""WITH {Q.DIFF} SELECT securable_type, full_name, principal, privilege
        FROM diff WHERE change = 'remove'""",
    "grant_principals": f"""WITH {Q.GRANTS}
        SELECT securable_type, full_name, principal FROM src
          WHERE full_name IN (SELECT full_name FROM both_sec)
        UNION SELECT securable_type, full_name, principal FROM tgt
          WHERE full_name IN (SELECT full_name FROM both_sec)""",
    "grant_changes": f"WITH {Q.CHANGES} SELECT * FROM changes",
    "grant_change_kind": f"""WITH {Q.CHANGES}
        SELECT full_name, principal, CASE WHEN "add" <> '' AND "remove" <> '' THEN 'both'
          WHEN "add" <> '' THEN 'add' ELSE 'remove' END AS change_kind FROM changes""",
    "grant_status": f"""WITH {Q.DIFF}
        SELECT securable_type, full_name,
          CASE WHEN full_name NOT IN (SELECT full_name FROM tgt_sec) THEN 'NotFound'
               WHEN full_name IN (SELECT full_name FROM diff WHERE change <> 'same')
               THEN 'SUCCESS' END AS status
        FROM src_sec""",
    "grant_not_found": f"""WITH {Q.GRANTS} SELECT * FROM src_sec
        WHERE full_name NOT IN (SELECT full_name FROM tgt_sec)""",
    "grants_after": f"""WITH {Q.GRANTS}
        SELECT * FROM src WHERE full_name IN (SELECT full_name FROM both_sec)
        UNION ALL
        SELECT * FROM tgt WHERE full_name NOT IN (SELECT full_name FROM both_sec)""",
    "effective_grants": f"WITH {Q.EFFECTIVE} SELECT * FROM effective",
    "retention": f"WITH {Q.CHANGED_ORDERS} SELECT * FROM after_change",
    "listing_pages": f"""WITH {Q.TABLES}
        SELECT * REPLACE (schema AS catalog, owner AS schema) FROM inv""",
    "listing_gaps_found": f"""WITH {Q.TABLES}, {Q.PAGES}
        SELECT catalog, schema, 'missing page' AS problem, CAST(token AS VARCHAR) AS page_token
        FROM pages WHERE token IS NOT NULL AND token % 5 = 2
          AND (before_it IS NULL OR before_it % 5 <> 2)
        UNION ALL
        SELECT catalog, schema, 'page that none names', CAST(token AS VARCHAR)
        FROM pages WHERE token % 5 <> 2 AND before_it % 5 = 2
        UNION ALL
        SELECT catalog, schema, 'no last page', NULL
        FROM pages WHERE next_it IS NULL AND token % 5 = 2""",
    "least_grants": f"""WITH {Q.EFFECTIVE}, {Q.BELOW}
        SELECT * FROM effective e
        WHERE NOT EXISTS (
          SELECT 1 FROM below b JOIN effective c
            ON c.securable_type = b.kind AND c.full_name = b.container
          WHERE b.securable_type = e.securable_type AND b.full_name = e.full_name
            AND c.principal = e.principal AND c.privilege = e.privilege)""",
    "grant_placement": f"""WITH {Q.EFFECTIVE}, {Q.BELOW},
        wanted AS (
          SELECT * FROM effective WHERE CASE WHEN securable_type = 'TABLE' AND privilege = 'USE'
            THEN CAST(string_split(full_name, '_')[-1] AS BIGINT) % 40 <> 1 ELSE true END),
        sized AS (
          SELECT w.securable_type, w.full_name, w.principal, w.privilege,
            count(*) FILTER (WHERE b.full_name IS NOT NULL AND x.full_name IS NULL) AS n_surplus
          FROM wanted w
          LEFT JOIN below b ON b.kind = w.securable_type AND b.container = w.full_name
          LEFT JOIN wanted x ON x.securable_type = b.securable_type
            AND x.full_name = b.full_name AND x.principal = w.principal
            AND x.privilege = w.privilege
          GROUP BY ALL)
        SELECT s.*, CASE WHEN n_surplus > 0 THEN 'refused'
          WHEN EXISTS (
            SELECT 1 FROM below b JOIN sized c
              ON c.securable_type = b.kind AND c.full_name = b.container
            WHERE b.securable_type = s.securable_type AND b.full_name = s.full_name
              AND c.principal = s.principal AND c.privilege = s.privilege AND c.n_surplus = 0)
          THEN 'inherited' ELSE 'direct' END AS placement
        FROM sized s""",
    "row_changes_between": f"""WITH {Q.LATER_ORDERS},
        went AS (SELECT * FROM orders EXCEPT ALL SELECT * FROM later),
        came AS (SELECT * FROM later EXCEPT ALL SELECT * FROM orders)
        SELECT *, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM came) THEN 'update_before'
          ELSE 'delete' END AS change, count(*) AS copies FROM went GROUP BY ALL
        UNION ALL
        SELECT *, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM went) THEN 'update_after'
          ELSE 'insert' END AS change, count(*) AS copies FROM came GROUP BY ALL""",
    "row_changes_applied": f"""WITH {Q.LATER_ORDERS},
        went AS (SELECT * FROM orders EXCEPT ALL SELECT * FROM later),
        came AS (SELECT * FROM later EXCEPT ALL SELECT * FROM orders)
        (SELECT * FROM orders WHERE o_orderstatus <> 'P' EXCEPT ALL SELECT * FROM went)
        UNION ALL SELECT * FROM came""",
    "replicate_table": "SELECT * FROM orders",
    "replicate_partitioned": "SELECT * FROM orders",
    "replicate_changed": f"WITH {Q.CHANGED_ORDERS} SELECT * FROM after_change",
    "replicate_changed_work": f"""WITH {Q.CHANGED_ORDERS},
        parts AS (
          SELECT coalesce(b.o_year, a.o_year) AS y, coalesce(b.o_orderstatus, a.o_orderstatus) AS s,
            any_value(b.o_year) IS NOT NULL AS was, any_value(a.o_year) IS NOT NULL AS stays
          FROM (SELECT DISTINCT o_year, o_orderstatus FROM before_change) b
          FULL JOIN (SELECT DISTINCT o_year, o_orderstatus FROM after_change) a
            ON a.o_year = b.o_year AND a.o_orderstatus = b.o_orderstatus GROUP BY ALL),
        moved AS (SELECT * FROM parts WHERE stays AND (NOT was OR (y = 1997 AND s = 'F')))
        SELECT CAST(1 AS BIGINT) AS run, (SELECT count(*) FROM before_change) AS n_rows,
          (SELECT count(*) FROM parts WHERE was) AS n_written, 0 AS n_kept, 0 AS n_dropped
        UNION ALL SELECT 2, (SELECT count(*) FROM after_change JOIN moved ON o_year = y AND o_orderstatus = s),
          (SELECT count(*) FROM moved), (SELECT count(*) FROM parts WHERE was AND stays) -
            (SELECT count(*) FROM moved WHERE was), (SELECT count(*) FROM parts WHERE NOT stays)
        UNION ALL SELECT 3, 0, 0, (SELECT count(*) FROM parts WHERE stays), 0""",
    "replicate_external": "SELECT * FROM lineitem",
    "view_order": """WITH v AS (
          SELECT s_suppkey AS k, s_suppkey % 5 AS p, s_suppkey // 5 AS g FROM supplier),
        looped AS (
          SELECT *, g % 4 = 3 AND 5 * g + 2 IN (SELECT k FROM v) AS looped FROM v)
        SELECT concat('v_', k) AS "view", CASE WHEN NOT looped THEN CAST(p AS INTEGER) END AS level,
          CASE WHEN looped AND p < 3 THEN 'views that depend on each other'
               WHEN looped THEN 'reads views that depend on each other' END AS problem
        FROM looped""",
    "locate_differences": """WITH spoilt AS (
          SELECT * REPLACE (CASE WHEN o_orderkey % 97 = 5 THEN o_totalprice + 1 ELSE o_totalprice END
            AS o_totalprice) FROM orders WHERE o_orderkey % 101 <> 7
          UNION ALL SELECT * FROM orders WHERE o_orderkey % 103 = 3),
        counted AS (
          SELECT *, 1 AS l, 0 AS r FROM orders UNION ALL SELECT *, 0, 1 FROM spoilt)
        SELECT * EXCLUDE (l, r), CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(r) AS BIGINT) AS n_right
        FROM counted GROUP BY ALL HAVING sum(l) <> sum(r)""",
    "replicate_view": """SELECT o_orderpriority, count(*) AS n_orders,
        max(o_totalprice) AS top_price, TRUE AS same FROM orders GROUP BY o_orderpriority""",
    "sync_status": _SYNC_STATUS,
    "sync_run": _sync_run(),
    "sync_resumed": _sync_run()
    + " ".join(
        f" UNION ALL SELECT 'written', '{t}', 'held', count(*) FROM {t}" for t in _TABLES
    ),
}
