"""Object names: dotted names as columns, quoted identifiers for DDL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qualified_name(*parts: Column | str) -> Column:
    """``catalog.schema.table`` as a column; null when a part is null."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    dotted = [columns[0]]
    for column in columns[1:]:
        dotted += [F.lit("."), column]
    return F.concat(*dotted)


def quote(*parts: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
