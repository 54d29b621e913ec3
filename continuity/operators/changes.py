"""Row changes between two versions of a table, told by key, and their application to a copy.

Changes are multisets of whole rows: what a version has more often than the other, with the
number of copies. Rows are located by the digest trees of ``difference``, so what is read after
the first level is bounded by what changed.

A key (any columns, nulls equal) tells updates from deletes and inserts: a key that loses rows
and gains rows is updated. Keys need not be unique; then rows of an updated key are not paired.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuity.functions.digest import row_hash
from continuity.operators.difference import DigestTree, differing_rows
from continuity.operators.joins import DEFAULT_LIMITS, JoinLimits, keyed_join
from continuity.workspace import stored

# Kinds of a change: rows that went and rows that came, of keys of which the other kind is
# missing or present.
DELETE, INSERT = "delete", "insert"
UPDATE_BEFORE, UPDATE_AFTER = "update_before", "update_after"
CHANGE, COPIES = "change", "copies"

_KEY, _HASH, _ROW = "__key", "__hash", "__row"


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def _refuse_clashes(columns: Sequence[str]) -> None:
    taken = {c.lower() for c in columns} & {CHANGE, COPIES, _KEY, _HASH, _ROW, "n_left", "n_right"}
    if taken:
        raise ValueError(f"columns that row changes need themselves: {sorted(taken)}")


def row_changes(
    before: DataFrame,
    after: DataFrame,
    keys: Sequence[str],
    before_tree: DigestTree | None = None,
    after_tree: DigestTree | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """One row per distinct row that the two versions do not have equally often: all columns,
    ``change`` and ``copies``.

    ``change`` is ``delete`` or ``insert`` for a key with rows of one kind only, otherwise
    ``update_before`` and ``update_after``. Indexes that are kept with the versions
    (``digest_tree``) spare the passes over them. Equal versions give no row. Columns named like
    those that are added raise.
    """
    _refuse_clashes(before.columns)
    missing = [k for k in keys if k not in before.columns]
    if missing or not keys:
        raise ValueError(f"no key columns {missing or list(keys)}")
    apart = stored(differing_rows(before, after, before_tree, after_tree), "row_changes")
    keyed = apart.withColumn(_KEY, F.struct(*_columns(keys)))
    went, came = F.col("n_left") > F.col("n_right"), F.col("n_right") > F.col("n_left")
    updated = (
        keyed.groupBy(_KEY)
        .agg(F.max(went).alias("went"), F.max(came).alias("came"))
        .filter("went AND came")
        .select(_KEY, F.lit(True).alias("updated"))
    )
    # A key may hold any share of the changes; its rows are spread by what they are.
    told = keyed_join(
        keyed, updated, [_KEY], "left", spread_by=[c for c in before.columns if c not in keys],
        limits=limits,
    )
    both = F.col("updated").isNotNull()
    change = F.when(went, F.when(both, UPDATE_BEFORE).otherwise(DELETE)).otherwise(
        F.when(both, UPDATE_AFTER).otherwise(INSERT)
    )
    return told.select(
        *_columns(before.columns),
        change.alias(CHANGE),
        F.abs(F.col("n_left") - F.col("n_right")).alias(COPIES),
    )


def change_counts(changes: DataFrame) -> DataFrame:
    """(change, n_rows, n_copies) for the kinds that occur."""
    return changes.groupBy(CHANGE).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(COPIES).alias("n_copies")
    )


def _gone(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col(CHANGE).isin(DELETE, UPDATE_BEFORE))


def _hashed(changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = changes.select(*_columns(columns))
    return changes.select(row_hash(rows).alias(_HASH), F.col(COPIES))


def _touched(base: DataFrame, changes: DataFrame, limits: JoinLimits) -> DataFrame:
    """The rows of ``base`` that the changes take away, each once: hash, how often it is there
    (n_held), how often it is taken (copies; 0 or null parts where one side lacks it)."""
    gone = _hashed(_gone(changes), base.columns)
    marked = base.withColumn(_HASH, row_hash(base))
    held = keyed_join(
        marked.select(_HASH), gone.select(_HASH).distinct(), [_HASH], "left_semi", limits=limits
    )
    rows = held.select(_HASH, F.lit(1).cast("bigint").alias("n_held"), F.lit(0).cast("bigint").alias(COPIES))
    rows = rows.unionByName(gone.withColumn("n_held", F.lit(0).cast("bigint")))
    return rows.groupBy(_HASH).agg(F.sum("n_held").alias("n_held"), F.sum(COPIES).alias(COPIES))


def conflicts(
    base: DataFrame, changes: DataFrame, limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Rows that the changes take away and ``base`` does not have as often: all columns,
    ``copies`` wanted and ``n_held``. None of them means that the changes fit the base."""
    _refuse_clashes(base.columns)
    lacking = _touched(base, changes, limits).filter(F.col("n_held") < F.col(COPIES))
    gone = _gone(changes)
    hashed = gone.withColumn(_HASH, row_hash(gone.select(*_columns(base.columns))))
    found = keyed_join(
        hashed.drop(CHANGE, COPIES), lacking, [_HASH], "inner", limits=limits
    )
    return found.select(*_columns(base.columns), COPIES, "n_held")


def apply_changes(
    base: DataFrame, changes: DataFrame, limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """``base`` without the rows that went and with those that came, as a multiset.

    Rows that no change takes away are passed on as they are: with few changes the base is
    read and not shuffled. Of a row that is taken away fewer times than it is there the rest
    stays; where ``base`` has fewer copies than are taken, none stays (see ``conflicts``).
    """
    _refuse_clashes(base.columns)
    columns = list(base.columns)
    touched = stored(_touched(base, changes, limits), "touched_rows")
    marked = base.withColumn(_HASH, row_hash(base))
    untouched = keyed_join(marked, touched.select(_HASH), [_HASH], "left_anti", limits=limits)
    # Rows that are there more often than they go come back from the changes, which have them.
    left = touched.filter(F.col("n_held") > F.col(COPIES)).select(
        _HASH, (F.col("n_held") - F.col(COPIES)).alias("n")
    )
    gone = _gone(changes)
    hashed = gone.select(
        *_columns(columns), row_hash(gone.select(*_columns(columns))).alias(_HASH)
    )
    rest = keyed_join(hashed, left, [_HASH], "inner", limits=limits)
    came = changes.filter(F.col(CHANGE).isin(INSERT, UPDATE_AFTER)).select(
        *_columns(columns), F.col(COPIES).alias("n")
    )
    repeated = rest.select(*_columns(columns), "n").unionByName(came)
    copies = repeated.select(
        *_columns(columns), F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias(_ROW)
    )
    return untouched.select(*_columns(columns)).unionByName(copies.select(*_columns(columns)))
