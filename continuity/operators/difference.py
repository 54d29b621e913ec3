"""Where two tables differ: a tree of digests over ranges of the row hash.

Each side is indexed once. Its leaves are the distinct row hashes with how often they occur and
one file they occur in, sorted by hash within each file of the index, in small pages. Its nodes
are digests of hash ranges: the finest are stored, coarser ones are their sums.

The trees are descended level by level: only children of ranges that differ are compared. Leaves
are then read for the finest differing ranges alone (a range of hashes is a filter that skips
pages), and rows are fetched for the differing hashes alone, from the files that hold them. What
is read after the first level is bounded by what differs, not by the tables.

Building an index moves 24 bytes per distinct row of a task through one shuffle, combined on the
map side, so equal rows never pile up. An index can be kept with a copy and compared again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from continuity.functions.digest import row_hash
from continuity.operators.joins import keyed_join
from continuity.workspace import run_folder, stored

# Bits of the hash that one level adds, and at most how many levels there are.
STEP = 8
LEVELS = 3
# Distinct hashes per finest range, and rows per page of the leaves.
RANGE_ROWS = 4096
# Up to this many ranges or files are named in a scan's filter; more are found by a join.
NAMED = 500

_HASH, _FILE = "__hash", "__file"


@dataclass(frozen=True)
class DigestTree:
    """One side's index, in a folder: ``leaves`` (h, n, file), ``nodes`` (id, n_hashes, n_rows,
    low, high) of the finest level, ``files`` (file, path)."""

    spark: SparkSession
    folder: str
    levels: int

    @property
    def leaves(self) -> DataFrame:
        return self.spark.read.schema("h bigint, n bigint, file bigint").parquet(
            f"{self.folder}/leaves"
        )

    @property
    def files(self) -> DataFrame:
        return self.spark.read.schema("file bigint, path string").parquet(f"{self.folder}/files")

    def nodes(self, level: int) -> DataFrame:
        """Digests of the ranges of a level, from 1 (coarse) to ``levels``."""
        finest = self.spark.read.schema(
            "id bigint, n_hashes bigint, n_rows bigint, low bigint, high bigint"
        ).parquet(f"{self.folder}/nodes")
        if level == self.levels:
            return finest
        up = F.shiftright("id", STEP * (self.levels - level))
        return finest.groupBy(up.alias("id")).agg(
            *[F.sum(c).alias(c) for c in ("n_hashes", "n_rows", "low", "high")]
        )


def _range_id(level: int) -> Column:
    """Signed, so ranges are in the order of their hashes."""
    return F.shiftright("h", 64 - STEP * level)


def _node_digest() -> list[Column]:
    """Sums over a hash of (hash, count), in halves that cannot overflow."""
    mixed = F.xxhash64("h", "n")
    return [
        F.count(F.lit(1)).alias("n_hashes"),
        F.sum("n").alias("n_rows"),
        F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.sum(F.shiftrightunsigned(mixed, 32)).alias("high"),
    ]


def _with_file(df: DataFrame) -> DataFrame:
    """The hash of every row and of the file it is in (null where it is in none)."""
    hashed = row_hash(df).alias(_HASH)
    try:
        return df.select(hashed, F.xxhash64("_metadata.file_path").alias(_FILE))
    except AnalysisException:
        return df.select(hashed, F.lit(None).cast("bigint").alias(_FILE))


def _files(df: DataFrame) -> DataFrame:
    try:
        path = df.select(F.col("_metadata.file_path").alias("path")).distinct()
    except AnalysisException:
        path = df.sparkSession.createDataFrame([], "path string")
    return path.select(F.xxhash64("path").alias("file"), "path")


def digest_tree(df: DataFrame, folder: str | None = None, levels: int | None = None) -> DigestTree:
    """Index ``df`` in a new folder. Trees that are compared need not have the same number of
    levels; without one given it follows from the number of distinct rows."""
    spark = df.sparkSession
    folder = folder or run_folder(spark, "digest_tree")
    hashes = _with_file(df).groupBy(F.col(_HASH).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.min(_FILE).alias("file")
    )
    hashes.sortWithinPartitions("h").write.option(
        "parquet.page.row.count.limit", RANGE_ROWS
    ).parquet(f"{folder}/leaves")
    tree = DigestTree(spark, folder, levels or 1)
    if levels is None:
        distinct = tree.leaves.count()
        levels = 1
        while levels < LEVELS and distinct > RANGE_ROWS << (STEP * levels):
            levels += 1
        tree = DigestTree(spark, folder, levels)
    tree.leaves.groupBy(_range_id(levels).alias("id")).agg(*_node_digest()).write.parquet(
        f"{folder}/nodes"
    )
    _files(df).write.parquet(f"{folder}/files")
    return tree


def differing_ranges(left: DigestTree, right: DigestTree) -> tuple[DataFrame, int]:
    """(id) of the finest ranges whose digests differ, and their level."""
    levels = min(left.levels, right.levels)
    found: DataFrame | None = None
    for level in range(1, levels + 1):
        sides = []
        for sign, tree in ((1, left), (-1, right)):
            nodes = tree.nodes(level)
            if found is not None:
                above = found.withColumnRenamed("id", "above")
                nodes = nodes.withColumn("above", F.shiftright("id", STEP)).join(
                    above, "above", "left_semi"
                )
            sides.append(
                nodes.select("id", *[(F.col(c) * sign).alias(c) for c in ("n_hashes", "n_rows", "low", "high")])
            )
        summed = sides[0].unionByName(sides[1]).groupBy("id").agg(
            *[F.sum(c).alias(c) for c in ("n_hashes", "n_rows", "low", "high")]
        )
        apart = summed.filter("n_hashes <> 0 OR n_rows <> 0 OR low <> 0 OR high <> 0")
        found = stored(apart.select("id"), "differing_ranges")
    return found, levels


def leaves_in(
    tree: DigestTree, ranges: DataFrame, level: int, named: int = NAMED
) -> DataFrame:
    """The leaves within the ranges (id) of a level."""
    ids = [r.id for r in ranges.limit(named + 1).collect()]
    if len(ids) > named:
        marked = tree.leaves.withColumn("id", _range_id(level))
        return marked.join(ranges, "id", "left_semi").drop("id")
    width = 1 << (64 - STEP * level)
    inside = F.lit(False)
    # Neighbouring ranges are one range, so the filter stays short.
    for first, last in _merged(sorted(ids)):
        inside = inside | F.col("h").between(first * width, last * width + width - 1)
    return tree.leaves.filter(inside)


def _merged(ids: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for one in ids:
        if runs and runs[-1][1] == one - 1:
            runs[-1] = (runs[-1][0], one)
        else:
            runs.append((one, one))
    return runs


def differing_hashes(left: DigestTree, right: DigestTree, named: int = NAMED) -> DataFrame:
    """(h, n_left, n_right, left_file, right_file) of the hashes that do not occur equally often."""
    ranges, level = differing_ranges(left, right)
    rows = None
    for name, tree in (("left", left), ("right", right)):
        one = leaves_in(tree, ranges, level, named)
        n = [F.col("n") if name == side else F.lit(0).cast("bigint") for side in ("left", "right")]
        files = [
            F.col("file") if name == side else F.lit(None).cast("bigint")
            for side in ("left", "right")
        ]
        one = one.select(
            "h", n[0].alias("n_left"), n[1].alias("n_right"),
            files[0].alias("left_file"), files[1].alias("right_file"),
        )
        rows = one if rows is None else rows.unionByName(one)
    summed = rows.groupBy("h").agg(
        F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"),
        F.max("left_file").alias("left_file"), F.max("right_file").alias("right_file"),
    )
    return stored(summed.filter("n_left <> n_right"), "differing_hashes")


def _in_files(df: DataFrame, tree: DigestTree, wanted: DataFrame, named: int) -> DataFrame:
    """``df`` cut down to the files (file) of ``wanted``, where these are known and not many."""
    if wanted.filter("file IS NULL").limit(1).count():
        return df
    known = tree.files.join(wanted.select("file").distinct(), "file", "left_semi")
    paths = [r.path for r in known.limit(named + 1).collect()]
    if len(paths) > named:
        return df
    return df.filter(F.col("_metadata.file_path").isin(paths) if paths else F.lit(False))


def differing_rows(
    left: DataFrame,
    right: DataFrame,
    left_tree: DigestTree | None = None,
    right_tree: DigestTree | None = None,
    named: int = NAMED,
) -> DataFrame:
    """Every distinct row that one side has more often, with n_left and n_right.

    Columns are matched by name. Rows are compared by a 64-bit hash of all columns.
    """
    if set(left.columns) != set(right.columns):
        raise ValueError("the two sides have different columns")
    right = right.select(*["`" + c.replace("`", "``") + "`" for c in left.columns])
    trees = (left_tree or digest_tree(left), right_tree or digest_tree(right))
    hashes = differing_hashes(*trees, named)
    found = None
    for df, tree, file, here in (
        (left, trees[0], "left_file", "n_left > 0"),
        (right, trees[1], "right_file", "n_left = 0"),
    ):
        wanted = hashes.filter(here)
        rows = _in_files(df, tree, wanted.select(F.col(file).alias("file")), named)
        hashed = rows.withColumn(_HASH, row_hash(df))
        counts = wanted.select(F.col("h").alias(_HASH), "n_left", "n_right")
        one = keyed_join(hashed, counts, [_HASH], "inner").dropDuplicates([_HASH]).drop(_HASH)
        found = one if found is None else found.unionByName(one)
    return found
