"""Fill-in-middle: cut texts at unit borders and move the middle to the end.

A unit is a run of ASCII letters or any other single character. The cuts are given as numbers
of units; where they lie in a text is looked up in a Fenwick tree. The text, as UTF-8, is laid
out in blocks of fixed size, and the tree holds for each block how many units and how many code
points begin in it. Binary-lifting descent walks from the root to the last block before a cut
and sums both counts on the way; the border itself is then searched in that one block. A text is
scanned once, in slices of a fixed number of blocks, so what a task holds besides the text does
not grow with it; each cut costs the logarithm of the number of blocks and one block.

Only the three numbers (units, places of both cuts) come back from Python. Outputs are put
together, and texts rebuilt from them, by columns.

Defined cases: a null text counts as empty; a text that is empty or holds a marker stays plain,
with null places; a null key draws as an empty one; repeated keys draw alike, texts with the same
key may still be cut elsewhere because they differ in units; of the other columns only those asked
for are carried, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuity.llm.columns import column

BLOCK = 1024
# Blocks scanned at once.
_SLICE = 256

PLAIN, PSM, SPM = "plain", "psm", "spm"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class BlockTree:
    """Fenwick tree over the blocks of one text: units and code points that begin in each."""

    def __init__(self, text: str, block: int = BLOCK):
        self.data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        self.block = block
        blocks = -(-len(self.data) // block)
        counts = np.zeros((blocks + 1, 2), dtype=np.int64)
        for first in range(0, blocks, _SLICE):
            last = min(first + _SLICE, blocks)
            begins, leads = self._begins(first * block, last * block)
            edges = np.arange(0, len(leads), block)
            counts[first + 1 : last + 1, 0] = np.add.reduceat(begins, edges, dtype=np.int64)
            counts[first + 1 : last + 1, 1] = np.add.reduceat(leads, edges, dtype=np.int64)
        self.units, self.chars = (int(total) for total in counts.sum(axis=0))
        # Every node gets its own count, then hands its sum to the node above it.
        self.tree = counts
        for node in range(1, blocks + 1):
            above = node + (node & -node)
            if above <= blocks:
                self.tree[above] += self.tree[node]

    def _begins(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Where units and where code points begin, for the bytes from ``start`` to ``stop``."""
        part = self.data[start:stop]
        lowered = part | 0x20
        letters = (lowered >= ord("a")) & (lowered <= ord("z"))
        after_letter = np.empty_like(letters)
        after_letter[1:] = letters[:-1]
        before = int(self.data[start - 1]) | 0x20 if start else 0
        after_letter[:1] = ord("a") <= before <= ord("z")
        leads = (part & 0xC0) != 0x80
        return leads & ~(letters & after_letter), leads

    def place(self, units: int) -> int:
        """Code points before unit number ``units`` (from 0); all of them from the last unit on."""
        if units >= self.units:
            return self.chars
        node, step = 0, 1 << (len(self.tree).bit_length() - 1)
        units_before = chars_before = 0
        while step:
            following = node + step
            if following < len(self.tree) and units_before + self.tree[following, 0] <= units:
                node = following
                units_before += int(self.tree[following, 0])
                chars_before += int(self.tree[following, 1])
            step >>= 1
        begins, leads = self._begins(node * self.block, (node + 1) * self.block)
        border = np.flatnonzero(begins)[units - units_before]
        return chars_before + int(leads[:border].sum())


def cut_text(text: str | None, first: int, second: int, block: int = BLOCK) -> tuple[int, int, int]:
    """Units of the text, and code points before each of the two cuts. A draw becomes a number of
    units as its remainder by the number of units plus one; the smaller one cuts first."""
    tree = BlockTree(text or "", block)
    low, high = sorted((first % (tree.units + 1), second % (tree.units + 1)))
    return tree.units, tree.place(low), tree.place(high)


def draws(key: Column, seed: str = "1:") -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of the seed and the key in decimal."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [
        F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)
    ]


def fill_in_middle(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    markers: Markers = Markers(),
    seed: str = "1:",
    moved_percent: int = 90,
    suffix_first_percent: int = 20,
    block: int = BLOCK,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """One row per row of ``df``: the columns in ``keep``, n (units), form, prefix_chars,
    middle_chars and output.

    Of the texts that may be moved, ``moved_percent`` in a hundred are; of those,
    ``suffix_first_percent`` in a hundred begin with the suffix (form spm), the others with the
    prefix (form psm).
    """
    clash = {c.lower() for c in keep} & set(RESULTS)
    if clash:
        raise ValueError(f"names of the results are asked for: {sorted(clash)}")

    @F.pandas_udf("n bigint, low bigint, high bigint")
    def cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        rows = [
            cut_text(t, a, b, block)
            for t, a, b in zip(texts, first.to_numpy(), second.to_numpy(), strict=True)
        ]
        return pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, 3), columns=["n", "low", "high"])

    rows = df.select(
        F.struct(*[column(k) for k in keep]).alias("kept"),
        column(text).alias("text"),
        F.array(*draws(column(key), seed)).alias("draws"),
    )
    draw = [F.col("draws")[k] for k in range(4)]
    cut = rows.withColumn("cut", cuts("text", draw[0], draw[1]))
    whole = F.coalesce("text", F.lit(""))
    low, high = F.col("cut.low"), F.col("cut.high")
    held = F.lit(False)
    for marker in markers.all():
        held = held | F.contains(whole, F.lit(marker))
    form = (
        F.when((whole == "") | held | (draw[2] % 100 >= moved_percent), PLAIN)
        .when(draw[3] % 100 < suffix_first_percent, SPM)
        .otherwise(PSM)
    )

    def piece(start: Column, length: Column) -> Column:
        return F.substring(whole, (start + 1).cast("int"), length.cast("int"))

    zero = F.lit(0)
    prefix, middle = piece(zero, low), piece(low, high - low)
    suffix = piece(high, F.char_length(whole) - high)
    p, s, m = (F.lit(marker) for marker in markers.all())
    output = (
        F.when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == SPM, F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(whole)
    )
    moved = F.col("form") != PLAIN
    return cut.withColumn("form", form).select(
        *[F.col("kept")[k].alias(k) for k in keep],
        F.col("cut.n").alias("n"),
        "form",
        F.when(moved, low).alias("prefix_chars"),
        F.when(moved, high - low).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: str = "output", form: str = "form", markers: Markers = Markers()) -> Column:
    """The text an output was made of. A moved output holds each marker once: texts with a marker
    stay plain, and no marker can arise where a piece and a marker meet, because no marker begins
    as another one ends."""

    def between(start: str, end: str | None) -> Column:
        begin = F.instr(column(output), start) + len(start)
        stop = F.instr(column(output), end) if end else F.char_length(column(output)) + 1
        return F.substring(column(output), begin, stop - begin)

    p, s, m = markers.all()
    return (
        F.when(column(form) == PSM, F.concat(between(p, s), between(m, None), between(s, m)))
        .when(column(form) == SPM, F.concat(between(p, m), between(m, None), between(s, p)))
        .otherwise(column(output))
    )
