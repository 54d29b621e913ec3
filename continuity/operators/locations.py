"""Move storage paths from the source's external locations to the target's.

A path belongs to the location whose url is its longest prefix that ends at a path boundary.
The url is replaced, once, by the url of the target location of the same name.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuity.operators.joins import DEFAULT_LIMITS, JoinLimits, fits_broadcast, keyed_join, shuffled

NO_LOCATION = "no location"
NO_TARGET_LOCATION = "no target location"

# Scheme and first path element, for instance "abfss://container@account".
_ROOT = "^([A-Za-z][A-Za-z0-9+.-]*:)?/*[^/]*"
# A url that names no place at all, such as "s3://"; nothing can lie below it.
_EMPTY = "^([A-Za-z][A-Za-z0-9+.-]*:)?/*$"
# Up to this many locations each path looks through those of its own root.
_FEW = 2_000


def _bare(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def location_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row per source url: name, url, and target_url (null when the target lacks it).

    Of several names for one url the smallest counts.
    """
    named = source.filter(~F.col("url").rlike(_EMPTY))
    unique = named.groupBy(_bare(F.col("url")).alias("url")).agg(F.min("name").alias("name"))
    targets = target.groupBy("name").agg(F.min(_bare(F.col("url"))).alias("target_url"))
    return unique.join(shuffled(targets), "name", "left").select("name", "url", "target_url")


def remap_locations(
    tables: DataFrame,
    source_locations: DataFrame,
    target_locations: DataFrame,
    path: str = "storage_location",
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Add location_name, target_location and problem (null when the path could be moved).

    What a row gets depends on its path alone, however many locations there are.
    """
    pairs = location_pairs(source_locations, target_locations)
    few = replace(limits, broadcast_rows=min(_FEW, limits.broadcast_rows))
    if fits_broadcast(pairs, few, tables):
        matched = _by_root(tables, pairs, path)
    else:
        matched = _by_ancestor(tables, pairs, path, limits)
    found, target = F.col("__found"), F.col("__found.target_url")
    rest = F.substring(F.col(path), F.col("__found.len") + 1, F.length(path))
    problem = F.when(found.isNull(), NO_LOCATION).when(target.isNull(), NO_TARGET_LOCATION)
    return matched.select(
        *tables.columns,
        found["name"].alias("location_name"),
        F.concat(target, rest).alias("target_location"),
        problem.alias("problem"),
    )


def _entry() -> Column:
    return F.struct(F.length("url").alias("len"), "url", "name", "target_url")


def _by_root(tables: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    """Few locations (measured): one broadcast row per root, the longest prefix is picked
    within the row. The tables are not shuffled and not multiplied."""
    per_root = pairs.groupBy(F.regexp_extract("url", _ROOT, 0).alias("__root")).agg(
        F.collect_list(_entry()).alias("__near")
    )
    where = F.col(path)
    fitting = F.filter(
        "__near",
        lambda e: (where == e["url"]) | where.startswith(F.concat(e["url"], F.lit("/"))),
    )
    return (
        tables.withColumn("__root", F.regexp_extract(path, _ROOT, 0))
        .join(F.broadcast(per_root), "__root", "left")
        .withColumn("__found", F.array_max(fitting))
    )


def _by_ancestor(
    tables: DataFrame, pairs: DataFrame, path: str, limits: JoinLimits
) -> DataFrame:
    """Many locations: each path meets the locations by equality on its own ancestors, so a
    root shared by a third of the rows gives as many rows as a path is deep, not all pairs.
    Different paths are looked up once, and every row finds its entry by its path again."""
    paths = tables.select(path).filter(F.col(path).isNotNull()).distinct()
    steps = F.split(path, "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda depth: F.array_join(F.slice(steps, 1, depth), "/"),
    )
    spread = paths.select(path, F.explode(ancestors).alias("url"))
    entries = pairs.select("url", _entry().alias("__entry"))
    hits = keyed_join(spread, entries, ["url"], "inner", spread_by=[path], limits=limits)
    best = hits.groupBy(path).agg(F.max("__entry").alias("__found"))
    return keyed_join(tables, best, [path], "left", limits=limits)
