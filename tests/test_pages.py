from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError

from continuity.sources import pages as P
from continuity.workspace import run_folder
from tests.helpers import plan, rows


def page(schema, token, following, *names):
    return (schema, token, following, [(n, "MANAGED", "parquet", None, None, "me") for n in names])


DDL = (
    "schema string, page_token string, next_page_token string, items array<struct<name string, "
    "table_type string, format string, storage_location string, view_definition string, owner string>>"
)


def export(spark, pages):
    folder = run_folder(spark, "pages")
    for catalog, cells in pages.items():
        spark.createDataFrame(cells, DDL).write.json(f"{folder}/tables/catalog={catalog}")
    return folder


def gaps(spark, cells):
    found = P.listing_gaps(P.read_pages(spark, export(spark, {"c": cells})))
    return {(r.schema, r.problem, r.page_token) for r in found.collect()}


def test_items_of_whole_listings(spark):
    folder = export(
        spark,
        {
            "007": [page("s", None, "x", "t1", "t2"), page("s", "x", "", "t3"), page("s", "x", "", "t3")],
            "d": [page("s", "", None, "t1"), page("empty", None, None)],
        },
    )
    pages = P.read_pages(spark, folder)
    found, none = P.complete_listing(pages)
    names = rows(found.select("catalog", "schema", "name"))
    assert names == {("007", "s", "t1"): 1, ("007", "s", "t2"): 1, ("007", "s", "t3"): 1, ("d", "s", "t1"): 1}
    assert none.count() == 0 and found.columns[:3] == ["catalog", "schema", "name"]
    some = pages.filter("catalog = 'd'")
    assert "PartitionFilters: [isnotnull(catalog" in plan(some) and some.count() == 2
    assert "items" not in plan(P.listing_gaps(pages)).rsplit("ReadSchema", 1)[-1]


def test_every_gap_is_told(spark):
    assert gaps(spark, [page("s", "x", None, "t")]) == {
        ("s", "no first page", None), ("s", "page that none names", "x"),
    }
    assert gaps(spark, [page("s", None, "x", "t"), page("r", None, None)]) == {
        ("s", "missing page", "x"), ("s", "no last page", None),
    }
    assert gaps(spark, [page("s", None, "x"), page("s", "x", "x")]) == {("s", "no last page", None)}
    assert gaps(spark, [page(None, None, "x"), page("s", None, None)]) == {
        (None, "missing page", "x"), (None, "no last page", None),
    }


def test_schemas_with_gaps_are_refused_or_left_out(spark):
    cells = [page("s", None, "x", "t"), page(None, None, "y", "u"), page("r", None, None, "v")]
    pages = P.read_pages(spark, export(spark, {"c": cells}))
    with pytest.raises(ValueError, match="missing page x"):
        P.complete_listing(pages)
    found, told = P.complete_listing(pages, strict=False)
    assert [r.name for r in found.collect()] == ["v"]
    assert {r.schema for r in told.collect()} == {"s", None}


def test_a_line_that_is_no_page_raises(spark):
    folder = export(spark, {"c": [page("s", None, None, "t")]})
    spark.createDataFrame([('{"schema": "s", "items": [',)], "value string").write.mode("append").text(
        f"{folder}/tables/catalog=c"
    )
    with pytest.raises(Py4JJavaError, match="MALFORMED_RECORD"):
        P.complete_listing(P.read_pages(spark, folder))
    assert P.listing_gaps(P.read_pages(spark, export(spark, {"c": []}))).count() == 0
