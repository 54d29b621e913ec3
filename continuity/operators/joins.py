"""Equi-joins of a large side with a lookup side, safe against hot keys.

Two ways, tried in this order:

1. the lookup side was measured (rows and bytes, one aggregate) and fits: broadcast hint;
2. otherwise a shuffled join. Keys that hold a large share of the big side are found with a
   sketch and only their rows are salted, on the lookup side they are repeated once per salt.

The optimizer's estimate broadcasts nothing: it starts from the sizes of compressed files, and
a few MB of them can be GB of rows, all of which would pass through the driver.

The sketch decides only where rows go. The result is the same whatever it says.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SALT = "__salt"
# What the optimizer reports for a frame of unknown size.
_UNKNOWN = (1 << 63) - 1


@dataclass(frozen=True)
class JoinLimits:
    """Bounds of ``keyed_join``; tests lower them to reach every path."""

    broadcast_rows: int = 500_000
    broadcast_bytes: int = 64 << 20
    # A lookup side is measured when it reads no more than this, or no more than the big side:
    # one pass over it against a shuffle of the big side.
    measure_bytes: int = 64 << 30
    # A key is hot when it has this many rows and 1/share of all rows.
    hot_rows: int = 2_000_000
    hot_share: int = 200


DEFAULT_LIMITS = JoinLimits()


def estimated_bytes(df: DataFrame) -> int:
    """Size of ``df`` by the optimizer's statistics (file sizes for plain scans)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files ``df`` reads. Frames made on the driver have no known size and are
    small; joins inside ``df`` do not multiply here, as they do in the optimizer's estimate."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < _UNKNOWN)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark is not to broadcast by its estimate."""
    return df.hint("merge")


def fits_broadcast(
    df: DataFrame, limits: JoinLimits = DEFAULT_LIMITS, big: DataFrame | None = None
) -> bool:
    """Measure ``df``: true when it is proven to have few enough rows and bytes."""
    worth = max(limits.measure_bytes, 0 if big is None else input_bytes(big))
    if input_bytes(df) > worth:
        return False
    size: Column = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        column = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(column)
        size = size + F.coalesce(F.octet_length(column.cast("string")), F.lit(0)) + 8
    rows, total = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows <= limits.broadcast_rows and (total or 0) <= limits.broadcast_bytes


def hot_keys(
    df: DataFrame, on: Sequence[str], limits: JoinLimits = DEFAULT_LIMITS
) -> tuple[list[int], int]:
    """Hashes of the hot keys of ``df`` and the number of salts to spread each over.

    One map-only pass over the key columns; what reaches the driver is one row with at most
    ``hot_share`` entries.
    """
    hashed = df.select(F.xxhash64(*on).alias("h"))
    tracked = min(1_000_000, 100 * limits.hot_share)
    sketch = f"approx_top_k(h, {limits.hot_share}, {tracked})"
    total, top = hashed.agg(F.count(F.lit(1)), F.expr(sketch)).first()
    bound = max(limits.hot_rows, total / limits.hot_share)
    found = {entry["item"]: entry["count"] for entry in top or [] if entry["count"] >= bound}
    if not found:
        return [], 1
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = math.ceil(max(found.values()) / total * partitions)
    return list(found), max(2, salts)


def keyed_join(
    big: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    keys_of: DataFrame | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """``big.join(lookup, on, how)`` for how in inner, left, left_semi, left_anti.

    ``spread_by``: columns of ``big`` that tell rows of one key apart, used to salt.
    ``keys_of``: a cheaper frame with the same key frequencies as ``big``, if there is one.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    on = list(on)
    if fits_broadcast(lookup, limits, big):
        return big.join(F.broadcast(lookup), on, how)
    hot, salts = hot_keys(big if keys_of is None else keys_of, on, limits)
    if not hot:
        return big.join(shuffled(lookup), on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    spread = list(spread_by) or [c for c in big.columns if c not in on]
    salt = F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0))
    every_salt = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    salted = big.withColumn(_SALT, salt.cast("int"))
    repeated = lookup.withColumn(_SALT, F.explode(every_salt))
    return salted.join(shuffled(repeated), [*on, _SALT], how).drop(_SALT)
