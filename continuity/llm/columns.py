"""Small column helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that separates words: space and the control characters tab to carriage return.
_SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text: runs of anything but white space. A null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE_RUN), "")


def chars_in(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``, which stand in a regular expression's
    character class."""
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {name.lower() for name in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def column(name: str) -> Column:
    """A column by its literal name, dots and back ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
