"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint is the majority vote, bit by bit, of the hashes of its word shingles. Two
fingerprints link when at most ``radius`` of their 64 bits differ; linked fingerprints form
components.

Links are found exactly. A tile is the set of distinct fingerprints whose eight bytes have the
same population counts. Flipping ``r`` bits moves the vector of the eight counts by at most
``r`` steps, so tiles whose counts lie further apart are never compared. With radius 2 every
fingerprint is sent to its own tile and to the 16 that are one step away: two fingerprints
within the radius then meet in at least one tile. (A larger radius sends further, ``radius``
halved and rounded up.) Within a tile all pairs are compared with numpy: exclusive-or, bit
count.

No task holds a large tile: the tiles are counted first (one row per fingerprint, spread to the
neighbours after counting), and one with more than ``TILE_ROWS`` rows is dealt into blocks, whose
pairs are compared one by one. Rows come to a task sorted by what they are compared with, and
are compared as they come, some ``_AT_ONCE`` at a time.

Copies share one fingerprint and are folded into one row before anything is compared. A task
keeps the links of the rows it compares at a time in a union-find and hands on only a spanning
forest: at most one row per fingerprint it read, however dense the links are. The components are then found by
joins (``components``).

Defined cases: a null text is an empty one; a text without words has fingerprint zero, which
links like any other; fewer words than a shingle make one shingle of them all. Rows with equal
or null ids are rows like others; a component's id is its smallest id that is not null, null if
it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuity.llm.columns import column, free_name
from continuity.llm.components import component_labels
from continuity.operators.joins import keyed_join
from continuity.workspace import stored

SEED = 42
# Fingerprints compared at once: 2048 x 2048 results of one byte, 8 bytes while they are made.
_BLOCK = 2048
# Largest group that is compared by shifting the sorted rows against themselves.
_SHIFTS = 32
# A tile with more rows is dealt into blocks of about this many.
TILE_ROWS = 1 << 17
# Rows that a task compares and links at a time, more where one pair of blocks has more.
_AT_ONCE = 1 << 20
# Bits of a block's number.
_BITS = 20


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        parts = zip(*(words[k:] for k in range(shingle)), strict=False)
        hashes = [digest(x, SEED) for x in map(b" ".join, parts)]
    return int(_majority(np.array(hashes, dtype="<u8")))


def _majority(hashes: np.ndarray) -> np.uint64:
    """Bits that are set in more than half of the hashes, counted in slices of bounded size."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        bits = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3):
    """``df`` with the fingerprint of ``text`` as a signed 64-bit integer."""

    @F.pandas_udf("bigint")
    def fingerprints(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint_of(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return df.withColumn(out, fingerprints(column(text)))


def _moves(radius: int) -> np.ndarray:
    """What to add to a tile's key (eight counts, four bits each) to reach every tile that is
    at most ``radius`` halved, rounded up, steps away."""
    steps = [1 << (4 * k) for k in range(8)]
    found = {0}
    for _ in range((radius + 1) // 2):
        found |= {m + sign * step for m in found for step in steps for sign in (1, -1)}
    return np.array(sorted(found), dtype=np.int64)


def _tile_rows(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Every fingerprint once for each tile it is sent to."""
    moves = _moves(radius)
    shifts = (4 * np.arange(8)).astype(np.int64)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int64)
        # A count of 8 has its own bit, one above or below only moves the key: keys stay apart
        # because each count takes four bits and lies between -1 and 9 after a move of one.
        keys = ((counts + 2) << shifts).sum(axis=1) if len(fps) else np.zeros(0, np.int64)
        tiles = (keys[:, None] + moves[None, :]).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(tiles, pa.int64()), pa.array(np.repeat(fps, len(moves)), pa.int64())],
            names=["tile", "fp"],
        )


def close_pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple]:
    """Index arrays (i, j) of all pairs with equal key within the radius; keys are sorted."""
    # Bits of signed numbers would be counted on their absolute values.
    n, fps = len(keys), fps.view(np.uint64)
    if n < 2:
        return
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[first, n])
    small = np.repeat(sizes <= _SHIFTS, sizes)
    at = np.flatnonzero(small)
    for shift in range(1, _SHIFTS):
        at = at[at + shift < n]
        at = at[keys[at] == keys[at + shift]]
        if not len(at):
            break
        near = np.bitwise_count(fps[at] ^ fps[at + shift]) <= radius
        yield at[near], at[near] + shift
    for start, size in zip(first[sizes > _SHIFTS], sizes[sizes > _SHIFTS], strict=True):
        for a in range(start, start + size, _BLOCK):
            rows = fps[a : min(a + _BLOCK, start + size)]
            for b in range(a, start + size, _BLOCK):
                columns = fps[b : min(b + _BLOCK, start + size)]
                i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ columns[None, :]) <= radius)
                apart = i + a < j + b
                yield i[apart] + a, j[apart] + b


def close_across(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple]:
    """Index arrays (i, j) of all pairs of one of ``left`` and one of ``right`` within the radius."""
    left, right = left.view(np.uint64), right.view(np.uint64)
    for a in range(0, len(left), _BLOCK):
        rows = left[a : a + _BLOCK, None]
        for b in range(0, len(right), _BLOCK):
            apart = np.bitwise_count(rows ^ right[None, b : b + _BLOCK])
            i, j = np.nonzero(apart <= radius)
            yield i + a, j + b


def _runs(tile: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Where the rows of each tile and pair of blocks begin, in rows sorted by these."""
    pair = part >> _BITS
    changed = (tile[1:] != tile[:-1]) | (pair[1:] != pair[:-1])
    return np.flatnonzero(np.r_[len(tile) > 0, changed])


def _linked(tile: np.ndarray, part: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links of whole tiles and pairs of blocks, reduced to a spanning forest."""
    nodes, ids = np.unique(fp, return_inverse=True)
    parent = np.arange(len(nodes))
    first = _runs(tile, part)
    sizes = np.diff(np.r_[first, len(fp)])
    low, high = part >> (2 * _BITS), (part >> _BITS) & ((1 << _BITS) - 1)
    key = np.repeat(np.arange(len(first)), sizes)
    alone = np.flatnonzero(low == high)
    for i, j in close_pairs(key[alone], fp[alone], radius):
        _unite(parent, ids[alone[i]], ids[alone[j]])
    for start, size in zip(first, sizes, strict=True):
        if low[start] == high[start]:
            continue
        run = np.arange(start, start + size)
        own = part[run] & ((1 << _BITS) - 1)
        left, right = run[own == low[start]], run[own == high[start]]
        for i, j in close_across(fp[left], fp[right], radius):
            _unite(parent, ids[left[i]], ids[right[j]])
    parent = _roots(parent)
    linked = np.flatnonzero(parent != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes[parent[linked]], pa.int64()), pa.array(nodes[linked], pa.int64())],
        names=["a", "b"],
    )


def _forest(
    batches: Iterator[pa.RecordBatch], radius: int, at_once: int = _AT_ONCE
) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links of rows (tile, part, fp) sorted by tile and pair of blocks."""
    held: list[tuple[np.ndarray, ...]] = []
    n, wait = 0, at_once
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        n += batch.num_rows
        if n < wait:
            continue
        tile, part, fp = (np.concatenate(c) for c in zip(*held, strict=True))
        # The last pair of blocks may go on in the next batch.
        cut = int(_runs(tile, part)[-1])
        if cut:
            yield _linked(tile[:cut], part[:cut], fp[:cut], radius)
        held, n = [(tile[cut:], part[cut:], fp[cut:])], n - cut
        wait = max(at_once, 2 * n)
    if n:
        tile, part, fp = (np.concatenate(c) for c in zip(*held, strict=True))
        yield _linked(tile, part, fp, radius)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i[k] and j[k] for all k, in whole-array steps."""
    while len(i):
        parent[:] = _roots(parent) if len(i) > 64 else parent
        a, b = _climb(parent, i), _climb(parent, j)
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _climb(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        above = parent[at]
        if np.array_equal(above, at):
            return at
        at = above


def _large_tiles(distinct: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """(tile, blocks) of the tiles that more than ``tile_rows`` fingerprints are sent to."""
    own = distinct.mapInArrow(lambda it: _tile_rows(it, 0), "tile bigint, fp bigint")
    counted = own.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    moves = F.array(*[F.lit(int(m)).cast("bigint") for m in _moves(radius)])
    sent = counted.select(F.explode(moves).alias("move"), "tile", "n")
    sizes = sent.groupBy((F.col("tile") + F.col("move")).alias("tile")).agg(F.sum("n").alias("n"))
    large = sizes.filter(F.col("n") > tile_rows)
    return stored(
        large.select("tile", F.ceil(F.col("n") / tile_rows).cast("bigint").alias("blocks")), "tiles"
    )


def _dealt(sent: DataFrame, large: DataFrame) -> DataFrame:
    """(tile, part, fp): rows of large tiles once for each pair of blocks theirs is in; ``part``
    holds the pair and the row's own block, 0 for tiles that stay whole."""
    joined = keyed_join(sent, large, ["tile"], "left", spread_by=["fp"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    packed = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda k: F.shiftleft(F.least(k, own), 2 * _BITS)
        + F.shiftleft(F.greatest(k, own), _BITS)
        + own,
    )
    whole = F.array(F.lit(0).cast("bigint"))
    parts = F.when(F.col("blocks").isNull(), whole).otherwise(packed)
    return joined.select("tile", F.explode(parts).alias("part"), "fp")


def links(
    fingerprints: DataFrame, fp: str = "fp", radius: int = 2, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """(a, b) of links between distinct fingerprints that join what all links join: a spanning
    forest of what a task compared at a time."""
    distinct = stored(fingerprints.select(column(fp).alias("fp")).distinct(), "fingerprints")
    large = _large_tiles(distinct, radius, tile_rows)
    partitions = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A file of fingerprints is small, what is sent to the tiles is 17 times as many rows.
    spread = distinct.repartition(partitions, "fp")
    sent = spread.mapInArrow(lambda it: _tile_rows(it, radius), "tile bigint, fp bigint")
    dealt = _dealt(sent, large)
    pair = F.shiftright("part", _BITS)
    return (
        dealt.repartition(partitions, "tile", pair)
        .sortWithinPartitions("tile", pair)
        .mapInArrow(lambda it: _forest(it, radius), "a bigint, b bigint")
    )


def _labelled(
    df: DataFrame, doc_id: str, text: str, shingle: int, radius: int, keep: tuple[str, ...]
) -> DataFrame:
    """doc_id, the columns in ``keep``, fp, component_id, and label: one of the component's
    fingerprints, which names it even where no id does."""
    kept = [column(k) for k in keep]
    narrow = df.select(column(doc_id).alias("doc_id"), *kept, column(text).alias("text_"))
    prints = stored(with_fingerprint(narrow, "text_", "fp", shingle).drop("text_"), "simhash")
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = component_labels(links(prints, "fp", radius))
    grouped = smallest.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")
    )
    ids = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(ids, "label").select("fp", "label", "component_id")
    return prints.join(named, "fp")


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """One row per row of ``df``: its id, fingerprint (16 hex digits) and component_id."""
    return _labelled(df, doc_id, text, shingle, radius, ()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_component(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """The rows of ``df`` with one document left of each component, the one with the smallest id.

    Rows that repeat an id and a text count as one document; one row of them stays. Of several
    texts with the smallest id, the one with the smallest hash stays. A document with a null id
    stays only in a component that has no other.
    """
    mark = free_name(df, "text_hash")
    marked = df.withColumn(mark, F.xxhash64(column(text)))
    found = _labelled(marked, doc_id, text, shingle, radius, (mark,))
    # Nulls sort last: a null id is taken only where there is no other.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", column(mark).alias("mark"))
    counted = found.groupBy("label", place.alias("place")).agg(F.count(F.lit(1)).alias("copies"))
    best = counted.groupBy("label").agg(
        F.min_by(F.struct("place", "copies"), "place").alias("best")
    )
    chosen = best.select(
        F.col("best.place.doc_id").alias("doc_id"),
        F.col("best.place.mark").alias("mark"),
        F.col("best.copies").alias("copies"),
    )
    copies = free_name(marked, "copies")
    stays = marked.alias("d").join(
        chosen.withColumnRenamed("copies", copies).alias("c"),
        F.expr(f"d.`{doc_id}` <=> c.doc_id") & (column(mark) == F.col("c.mark")),
    ).select("d.*", copies)
    single = stays.filter(column(copies) == 1).drop(copies, mark)
    repeated = (
        stays.filter(column(copies) > 1).dropDuplicates([doc_id, mark]).drop(copies, mark)
    )
    return single.unionByName(repeated)
