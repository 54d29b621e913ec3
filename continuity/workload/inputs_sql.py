"""The derivations of ``inputs`` as SQL common table expressions."""

from __future__ import annotations

FLIGHTS = """flights AS (
  SELECT l_orderkey, l_linenumber,
    CAST(year(l_shipdate) AS INTEGER) AS "Year",
    CAST(month(l_shipdate) AS INTEGER) AS "Month",
    CAST(day(l_shipdate) AS INTEGER) AS "DayofMonth",
    CAST(l_linenumber AS INTEGER) AS "DayOfWeek",
    CASE WHEN l_linenumber = 3 THEN 'NA' ELSE CAST(l_orderkey % 2400 AS VARCHAR) END AS "DepTime",
    CAST(l_orderkey % 2400 AS INTEGER) AS "CRSDepTime",
    CAST(l_partkey % 2400 AS VARCHAR) AS "ArrTime",
    CAST(l_partkey % 2400 AS INTEGER) AS "CRSArrTime",
    concat('C', l_suppkey % 20) AS "UniqueCarrier",
    CAST(l_suppkey AS INTEGER) AS "FlightNum",
    concat('N', l_partkey) AS "TailNum",
    CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS "ActualElapsedTime",
    CAST(l_quantity AS INTEGER) AS "CRSElapsedTime",
    'NA' AS "AirTime",
    CAST(CAST(l_quantity AS INTEGER) - 25 AS VARCHAR) AS "ArrDelay",
    CAST(l_linenumber - 1 AS VARCHAR) AS "DepDelay",
    concat('O', l_suppkey % 300) AS "Origin",
    concat('D', l_partkey % 300) AS "Dest",
    CAST(l_partkey AS VARCHAR) AS "Distance",
    'NA' AS "TaxiIn",
    'NA' AS "TaxiOut",
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "Cancelled",
    CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS "CancellationCode",
    0 AS "Diverted",
    CASE WHEN l_linenumber = 2 THEN '5' ELSE 'NA' END AS "CarrierDelay",
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F'
         THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE 'NA' END AS "WeatherDelay",
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O'
         THEN CAST(l_linenumber AS VARCHAR) ELSE 'NA' END AS "NASDelay",
    CASE WHEN l_tax = 0 THEN '0' ELSE 'NA' END AS "SecurityDelay",
    CASE WHEN l_discount = 0 THEN '0' WHEN l_discount = 0.1 THEN NULL ELSE 'NA' END
      AS "LateAircraftDelay",
    CASE WHEN l_quantity > 25 THEN 'YES' ELSE 'NO' END AS "IsArrDelayed",
    CASE WHEN l_linenumber = 1 THEN 'YES' ELSE 'NO' END AS "IsDepDelayed"
  FROM lineitem)"""

# The labels, the one with the smallest rank that holds counts.
_LABELS = ("WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay", "UncategorizedDelay")
# A row's labels are made a small table (rank, label, whether it holds), and the first is taken.
DELAY_TYPE = (
    "(SELECT arg_min(l.label, l.rank) FROM (VALUES "
    + ", ".join(f"({rank}, '{label}', \"{label}\" <> 'NA')" for rank, label in enumerate(_LABELS[:4]))
    + f""", (4, '{_LABELS[4]}', list_contains(["IsArrDelayed", "IsDepDelayed"], 'YES')))"""
    + " AS l(rank, label, holds) WHERE l.holds)"
)

BRAND = "CAST(split_part(p_brand, '#', 2) AS INTEGER)"
SCHEMA = (
    "CASE WHEN p_partkey % 97 = 0 THEN 'information_schema' "
    "ELSE replace(lower(p_brand), '#', '_') END"
)

TABLES = f"""inv AS (
  SELECT lower(p_type) AS catalog, {SCHEMA} AS schema, concat('t_', p_partkey) AS name,
    CASE p_size % 4 WHEN 0 THEN 'MANAGED' WHEN 3 THEN 'VIEW' ELSE 'EXTERNAL' END AS table_type,
    CASE WHEN p_size % 3 = 0 THEN 'delta' ELSE 'parquet' END AS format,
    CASE WHEN p_size % 7 = 0 THEN concat('other://x/', p_partkey)
         WHEN p_size % 7 = 1 THEN concat('src://r', p_size % 5, '/deep/', p_partkey)
         ELSE concat('src://r', p_size % 5, '/', p_partkey) END AS storage_location,
    CASE WHEN p_size % 4 = 3 THEN concat('SELECT ', p_partkey, ' AS k') END AS view_definition,
    concat('o_', p_size % 5) AS owner
  FROM part)"""

CATALOGS = """cats AS (
  SELECT DISTINCT lower(p_type) AS catalog,
    CASE WHEN length(p_type) % 2 = 1 THEN 'MANAGED_CATALOG' ELSE 'SYSTEM_CATALOG' END
      AS catalog_type
  FROM part)"""

SCHEMAS = f"""src_schemas AS (
  SELECT DISTINCT lower(p_type) AS catalog, {SCHEMA} AS schema FROM part),
tgt_schemas AS (
  SELECT DISTINCT lower(p_type) AS catalog, {SCHEMA} AS schema FROM part
  WHERE {BRAND} % 5 <> 0 OR p_partkey % 97 = 0)"""

LOCATIONS = """src_loc AS (
  SELECT concat('loc_', r_regionkey) AS name, concat('src://r', r_regionkey) AS url FROM region
  UNION ALL
  SELECT concat('deep_', r_regionkey), concat('src://r', r_regionkey, '/deep') FROM region),
tgt_loc AS (
  SELECT concat('loc_', r_regionkey) AS name, concat('dst://r', r_regionkey) AS url FROM region
  UNION ALL
  SELECT concat('deep_', r_regionkey), concat('dst2://r', r_regionkey, '/deep') FROM region
  WHERE r_regionkey <> 4)"""

REMAPPED = f"""{TABLES}, {CATALOGS}, {LOCATIONS},
ext AS (SELECT * FROM inv WHERE schema <> 'information_schema' AND table_type = 'EXTERNAL'
  AND catalog IN (SELECT catalog FROM cats WHERE catalog_type = 'MANAGED_CATALOG')),
hit AS (
  SELECT e.*, l.name AS location_name, l.url,
    row_number() OVER (PARTITION BY e.catalog, e.schema, e.name ORDER BY length(l.url) DESC) AS rn
  FROM ext e LEFT JOIN src_loc l
    ON e.storage_location = l.url OR starts_with(e.storage_location, concat(l.url, '/'))),
remapped AS (
  SELECT h.catalog, h.schema, h.name, h.format, h.storage_location, h.location_name,
    CASE WHEN t.url IS NOT NULL
         THEN concat(t.url, substr(h.storage_location, length(h.url) + 1)) END
      AS target_location,
    CASE WHEN h.location_name IS NULL THEN 'no location'
         WHEN t.url IS NULL THEN 'no target location' END AS problem
  FROM hit h LEFT JOIN tgt_loc t ON t.name = h.location_name
  WHERE h.rn = 1)"""

GRANTS = """src AS (
  SELECT DISTINCT 'TABLE' AS securable_type, concat('t_', l_partkey) AS full_name,
    concat('u_', l_suppkey) AS principal, concat(l_returnflag, l_linestatus) AS privilege
  FROM lineitem WHERE l_linenumber % 3 <> 2),
tgt AS (
  SELECT DISTINCT 'TABLE' AS securable_type, concat('t_', l_partkey) AS full_name,
    concat('u_', l_suppkey) AS principal, concat(l_returnflag, l_linestatus) AS privilege
  FROM lineitem WHERE l_linenumber % 3 <> 0),
src_sec AS (SELECT 'TABLE' AS securable_type, concat('t_', p_partkey) AS full_name
  FROM part WHERE p_partkey % 13 <> 0),
tgt_sec AS (SELECT 'TABLE' AS securable_type, concat('t_', p_partkey) AS full_name
  FROM part WHERE p_partkey % 10 <> 0),
both_sec AS (SELECT full_name FROM src_sec INTERSECT SELECT full_name FROM tgt_sec)"""

DIFF = f"""{GRANTS},
joined AS (
  SELECT coalesce(s.securable_type, t.securable_type) AS securable_type,
    coalesce(s.full_name, t.full_name) AS full_name,
    coalesce(s.principal, t.principal) AS principal,
    coalesce(s.privilege, t.privilege) AS privilege,
    CASE WHEN t.full_name IS NULL THEN 'add' WHEN s.full_name IS NULL THEN 'remove'
         ELSE 'same' END AS change
  FROM src s FULL OUTER JOIN tgt t
    ON s.full_name = t.full_name AND s.principal = t.principal AND s.privilege = t.privilege),
diff AS (SELECT * FROM joined WHERE full_name IN (SELECT full_name FROM both_sec))"""

CHANGES = f"""{DIFF},
changes AS (
  SELECT securable_type, full_name, principal,
    coalesce(string_agg(privilege, ',' ORDER BY privilege) FILTER (WHERE change = 'add'), '')
      AS "add",
    coalesce(string_agg(privilege, ',' ORDER BY privilege) FILTER (WHERE change = 'remove'), '')
      AS "remove"
  FROM diff WHERE change <> 'same' GROUP BY securable_type, full_name, principal)"""

VOLUMES = """src_vol AS (
  SELECT 'main' AS catalog, concat('s_', s_nationkey % 5) AS schema, concat('v_', s_suppkey) AS name,
    CASE WHEN s_suppkey % 11 = 0 THEN 'MANAGED' ELSE 'EXTERNAL' END AS volume_type,
    concat('vol://v/', s_suppkey) AS storage_location, concat('o_', s_nationkey) AS owner
  FROM supplier),
tgt_vol AS (
  SELECT 'main' AS catalog, concat('s_', s_nationkey % 5) AS schema, concat('v_', s_suppkey) AS name,
    CASE WHEN s_suppkey % 11 = 0 THEN 'MANAGED' ELSE 'EXTERNAL' END AS volume_type,
    concat('vol://v/', s_suppkey) AS storage_location,
    concat('o_', CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey + 1 ELSE s_nationkey END) AS owner
  FROM supplier WHERE s_suppkey % 3 <> 0)"""

CHANGED_ORDERS = """before_change AS (
  SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders),
after_change AS (
  SELECT * REPLACE (CASE WHEN o_year = 1997 AND o_orderstatus = 'F' THEN o_totalprice + 1
    ELSE o_totalprice END AS o_totalprice)
  FROM before_change WHERE NOT (o_year = 1995 AND o_orderstatus = 'P')
  UNION ALL
  SELECT * REPLACE (-o_orderkey AS o_orderkey, 2030 AS o_year)
  FROM before_change WHERE o_year = 1996 AND o_orderstatus = 'O')"""

EFFECTIVE = f"""{TABLES}, {CATALOGS}, {GRANTS},
cat_grants AS (SELECT catalog, 'admin' AS principal, 'ALL' AS privilege FROM cats),
sch_grants AS (
  SELECT DISTINCT lower(p_type) AS catalog, {SCHEMA} AS schema,
    concat('r_', {BRAND} % 3) AS principal, 'USE' AS privilege
  FROM part WHERE {BRAND} % 2 = 0 AND p_partkey % 97 <> 0),
sch AS (SELECT DISTINCT catalog, schema FROM inv),
user_inv AS (SELECT * FROM inv WHERE schema <> 'information_schema'),
effective AS (
  SELECT 'CATALOG' AS securable_type, catalog AS full_name, principal, privilege FROM cat_grants
  UNION
  SELECT 'SCHEMA', concat(s.catalog, '.', s.schema), g.principal, g.privilege
  FROM sch s JOIN sch_grants g USING (catalog, schema)
  UNION
  SELECT 'SCHEMA', concat(s.catalog, '.', s.schema), g.principal, g.privilege
  FROM sch s JOIN cat_grants g USING (catalog)
  UNION
  SELECT 'TABLE', concat(t.catalog, '.', t.schema, '.', t.name), g.principal, g.privilege
  FROM user_inv t JOIN src g ON g.full_name = t.name
  UNION
  SELECT 'TABLE', concat(t.catalog, '.', t.schema, '.', t.name), g.principal, g.privilege
  FROM user_inv t JOIN sch_grants g USING (catalog, schema)
  UNION
  SELECT 'TABLE', concat(t.catalog, '.', t.schema, '.', t.name), g.principal, g.privilege
  FROM user_inv t JOIN cat_grants g USING (catalog))"""

LATER_ORDERS = """later AS (
  SELECT * REPLACE (CASE WHEN o_orderkey % 89 = 4 THEN o_totalprice + 1 ELSE o_totalprice END
    AS o_totalprice) FROM orders WHERE o_orderkey % 101 <> 7
  UNION ALL
  SELECT * REPLACE (-o_orderkey AS o_orderkey) FROM orders WHERE o_orderkey % 103 = 3)"""

# Containers and what is listed below them.
BELOW = """objects AS (
  SELECT 'CATALOG' AS securable_type, catalog AS full_name, catalog, NULL AS schema FROM cats
  UNION ALL
  SELECT 'SCHEMA', concat(catalog, '.', schema), catalog, schema FROM sch
  UNION ALL
  SELECT 'TABLE', concat(catalog, '.', schema, '.', name), catalog, schema FROM user_inv),
below AS (
  SELECT c.securable_type AS kind, c.full_name AS container, o.securable_type, o.full_name
  FROM objects c JOIN objects o ON o.catalog = c.catalog
  WHERE (c.securable_type = 'CATALOG' AND o.securable_type <> 'CATALOG')
    OR (c.securable_type = 'SCHEMA' AND o.securable_type = 'TABLE' AND o.schema = c.schema))"""

# Pages of the table listing, with the tokens of the page before and of the next one.
PAGES = """numbered AS (
  SELECT DISTINCT schema AS catalog, owner AS schema, CAST(substr(name, 3) AS BIGINT) // 5 AS page
  FROM inv),
tokens AS (
  SELECT catalog, schema, page, CASE WHEN row_number() OVER w > 1 THEN page END AS token,
    lead(page) OVER w AS next_it
  FROM numbered WINDOW w AS (PARTITION BY catalog, schema ORDER BY page)),
pages AS (
  SELECT *, lag(token) OVER (PARTITION BY catalog, schema ORDER BY page) AS before_it FROM tokens)"""
