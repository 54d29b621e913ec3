"""Inventories from exported listing pages.

A metastore lists the objects of a schema in pages; each names the token of the next one. An
export keeps every page as one JSON line, below a folder per catalog:

    tables/catalog=main/....json
        {"schema": "s", "page_token": null, "next_page_token": "x1", "items": [{"name": ...}]}

Pages are read in parallel, in whatever order; a filter on the catalog leaves the other folders
unread. Whether the pages of a schema are all there follows from their tokens alone: a listing
with a hole would look as if objects were gone, so it is reported and not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from continuity import schemas as S
from continuity.operators.joins import keyed_join
from continuity.workspace import stored

_PARTS = {"tables": S.TABLES_DDL, "volumes": S.VOLUMES_DDL}
_SCHEMA = ["catalog", "schema"]
_PLACE = "__place"

# What can be wrong with a schema's pages.
NO_FIRST, MISSING, UNNAMED, NO_LAST = "no first page", "missing page", "page that none names", "no last page"


def _page_schema(part: str) -> T.StructType:
    declared = T.StructType.fromDDL(_PARTS[part])
    items = T.StructType([f for f in declared.fields if f.name not in _SCHEMA])
    return (
        T.StructType()
        .add("schema", T.StringType())
        .add("page_token", T.StringType())
        .add("next_page_token", T.StringType())
        .add("items", T.ArrayType(items))
        .add("catalog", T.StringType())
    )


def read_pages(spark: SparkSession, folder: str, part: str = "tables") -> DataFrame:
    """The pages of one part, as they are. A line that is no page raises: it may be a page."""
    return (
        spark.read.schema(_page_schema(part))
        .option("mode", "FAILFAST")
        .json(f"{folder}/{part}")
    )


def listing_gaps(pages: DataFrame) -> DataFrame:
    """(catalog, schema, problem, page_token) for schemas whose pages are not all there.

    Every page but the first (no token) is named by another, every named one is there, one
    has no next page. An empty token is none. Pages that were fetched twice do no harm. A circle
    of pages apart from the first one's chain is not told.

    One aggregate over tokens; the items are not read.
    """
    here = F.nullif("page_token", F.lit(""))
    following = F.nullif("next_page_token", F.lit(""))
    no_token = F.lit(None).cast("string")
    seen = pages.select(
        *_SCHEMA,
        F.explode(
            F.array(
                F.struct(here.alias("token"), F.lit(True).alias("there"), following.isNull().alias("last")),
                F.struct(following.alias("token"), F.lit(False).alias("there"), F.lit(False).alias("last")),
            )
        ).alias("one"),
    ).select(*_SCHEMA, "one.*")
    # The second entry of a last page names nothing.
    tokens = (
        seen.filter(F.col("there") | F.col("token").isNotNull())
        .groupBy(*_SCHEMA, "token")
        .agg(
            F.max("there").alias("there"),
            F.max(~F.col("there")).alias("named"),
            F.max("last").alias("last"),
        )
    )
    lone = tokens.filter(F.col("token").isNotNull() & (F.col("there") != F.col("named"))).select(
        *_SCHEMA,
        F.when(F.col("there"), UNNAMED).otherwise(MISSING).alias("problem"),
        F.col("token").alias("page_token"),
    )
    whole = tokens.groupBy(*_SCHEMA).agg(
        F.max(F.col("token").isNull()).alias("first"), F.max("last").alias("last")
    )
    ends = whole.select(
        *_SCHEMA,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(~F.col("first"), NO_FIRST),
                    F.when(~F.col("last"), NO_LAST),
                )
            )
        ).alias("problem"),
        no_token.alias("page_token"),
    )
    return lone.unionByName(ends)


def listed_items(pages: DataFrame, part: str = "tables") -> DataFrame:
    """The objects on the pages, each name of a schema once, in the columns of the inventory."""
    items = pages.select(*_SCHEMA, F.explode("items").alias("item")).select(*_SCHEMA, "item.*")
    names = [f.name for f in T.StructType.fromDDL(_PARTS[part]).fields]
    return items.dropDuplicates([*_SCHEMA, "name"]).select(*names)


def complete_listing(
    pages: DataFrame, part: str = "tables", strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The objects of schemas whose pages are all there, and the gaps of the others.

    ``strict`` raises for a gap; otherwise the schema is left out whole, and its objects must not
    be taken as gone by whoever uses the result.
    """
    gaps = stored(listing_gaps(pages), "listing_gaps")
    found = gaps.take(3)
    if not found:
        return listed_items(pages, part), gaps
    if strict:
        told = [f"{g.catalog}.{g.schema}: {g.problem} {g.page_token or ''}".strip() for g in found]
        raise ValueError(f"listings with gaps: {told}")
    # Nulls within a struct are equal.
    place = F.struct(*_SCHEMA).alias(_PLACE)
    whole = keyed_join(
        pages.select("*", place), gaps.select(place).distinct(), [_PLACE], "left_anti",
        spread_by=["page_token"],
    )
    return listed_items(whole, part), gaps
