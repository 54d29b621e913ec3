"""Order-free digest of a table, to check a copy against what was read.

A digest is a row count and four sums over slices of a 64-bit row hash. It is multiset-true:
two equal rows do not cancel, and neither row order nor file layout matters. The slices are
16 bits wide, so the sums fit a long up to 2**47 rows and stay primitive (a decimal sum of the
whole hash took 1.6 times as long).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SLICE = 16
_MASK = (1 << _SLICE) - 1
_SUMS = ("sum0", "sum1", "sum2", "sum3")


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(field.dataType) for field in kind.fields)
    return False


def _hashable(value: Column, kind: T.DataType) -> Column:
    """Maps have no order and cannot be hashed: give them as arrays of sorted entries."""
    if not _holds_map(kind):
        return value
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(
                _hashable(e["key"], kind.keyType).alias("key"),
                _hashable(e["value"], kind.valueType).alias("value"),
            ),
        )
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda e: _hashable(e, kind.elementType))
    fields = [_hashable(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
    return F.when(value.isNotNull(), F.struct(*fields))


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns of ``df``; null flags keep (null, x) and (x, null) apart."""
    parts: list[Column] = []
    for field in df.schema.fields:
        column = F.col("`" + field.name.replace("`", "``") + "`")
        parts += [_hashable(column, field.dataType), column.isNull()]
    return F.xxhash64(*parts)


def digest_aggregates(df: DataFrame) -> list[Column]:
    digest = row_hash(df)
    return [
        F.count(F.lit(1)).alias("rows"),
        *[
            F.sum(F.shiftrightunsigned(digest, k * _SLICE).bitwiseAND(F.lit(_MASK))).alias(name)
            for k, name in enumerate(_SUMS)
        ],
    ]


def digest(df: DataFrame) -> dict[str, int]:
    """The digest as one driver-side row: one pass, map-side combined."""
    return normal(df.agg(*digest_aggregates(df)).first().asDict())


def normal(values: Mapping[str, int | None]) -> dict[str, int]:
    """Sums over no rows are null (or missing from an observation): count them as zero."""
    return {name: int(values.get(name) or 0) for name in ("rows", *_SUMS)}


def same_digest(left: DataFrame, right: DataFrame) -> bool:
    return digest(left) == digest(right.select(*left.columns))
