"""Connected components of a graph that no task and not the driver can hold.

Alternating large-star and small-star steps over an edge table: every node's neighbours are
pointed at the smallest node among them until nothing changes. Each step is one aggregate and
one join; the edges are written to the shared folder between rounds, so lineage stays short
and a lost executor costs one round at most. The smallest neighbours are written as well: the
centre of a big star holds a large share of the edges, and its rows are spread over tasks in the
join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuity.operators.joins import keyed_join
from continuity.workspace import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of node and neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    up = both.filter("b > a")
    moved = keyed_join(up, least, ["a"], spread_by=["b"]).select(F.col("m").alias("a"), "b")
    return moved.filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = keyed_join(down, least, ["u"], spread_by=["v"]).select(
        F.col("m").alias("a"), F.col("v").alias("b")
    )
    own = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return moved.union(own).filter("a < b").distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that has an edge to another: the smallest node reachable.

    ``edges`` has columns a and b of one sortable type; direction, loops and repeats do not
    matter. Ends when a round changes nothing: every label is then the root of a star.
    """
    ordered = edges.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    current = stored(ordered.distinct(), "edges")
    while True:
        following = stored(_small_star(stored(_large_star(current), "edges")), "edges")
        changed = following.join(current, ["a", "b"], "left_anti").limit(1).count()
        same = following.count() == current.count()
        current = following
        if same and not changed:
            break
    return current.select(F.col("b").alias("node"), F.col("a").alias("label")).union(
        current.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("label"))
    )
