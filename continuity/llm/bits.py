"""A filter of bounded size for a set of hashes of any size.

The set's table stays distributed; what reaches the driver is a bit map of ``2**log2_bits``
bits: sixteen for each hash that was counted, within bounds (2 MB and 32 MB). Tasks make its
blocks, the driver only places them. A hash of the set always passes. Others pass with a
chance of (number of hashes) / (number of bits), so whatever passes is joined with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuity.llm.columns import column

LEAST_LOG2_BITS, MOST_LOG2_BITS = 24, 28
# Words of 64 bits that reach the driver as one row of 64 KB.
_BLOCK_WORDS = 1 << 13


def bits_for(hashes: int) -> int:
    """Logarithm of the bits that keep others out, with one chance in sixteen."""
    return min(MOST_LOG2_BITS, max(LEAST_LOG2_BITS, (16 * hashes - 1).bit_length()))


def _packed(
    batches: Iterator[pa.RecordBatch], words: int, of_block: int
) -> Iterator[pa.RecordBatch]:
    """The blocks, of ``of_block`` words each, that the batches have words of."""
    made, seen = np.zeros(words, dtype=np.int64), np.zeros(words // of_block, dtype=bool)
    for batch in batches:
        word = batch.column(0).to_numpy()
        made[word] = batch.column(1).to_numpy()
        seen[word // of_block] = True
    for block in np.flatnonzero(seen).tolist():
        bits = made[block * of_block : (block + 1) * of_block].tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"]
        )


def bit_filter(df: DataFrame, hashed: str, log2_bits: int | None = None) -> np.ndarray:
    """The bit map, as bytes, of the low bits of the signed 64-bit column ``hashed``."""
    if log2_bits is None:
        log2_bits = bits_for(df.count())
    low = F.col(hashed).bitwiseAND(F.lit((1 << log2_bits) - 1))
    word = F.shiftright(low, 6).cast("int")
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(F.lit(63)).cast("int")
    )
    # At most 2**(log2_bits - 6) words come out of this aggregate: millions of rows, each many
    # times the size of its bits on the driver. They are put together in tasks.
    words = 1 << (log2_bits - 6)
    of_block = min(_BLOCK_WORDS, words)
    blocks = (
        df.filter(F.col(hashed).isNotNull())
        .groupBy(word.alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .repartition(F.shiftright("word", of_block.bit_length() - 1))
        .mapInArrow(lambda it: _packed(it, words, of_block), "block int, bits binary")
    )
    made = np.zeros(words, dtype=np.int64)
    for row in blocks.collect():
        start = row["block"] * of_block
        made[start : start + of_block] |= np.frombuffer(row["bits"], dtype=np.int64)
    return made.view(np.uint8)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (any 64-bit type) may be in the set."""
    low = hashes.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    byte = bits[(low >> np.uint64(3)).astype(np.int64)]
    return (byte >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1


def split_by_keys(
    df: DataFrame, key: str, keys: DataFrame, log2_bits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` may be among ``keys`` (same column name), and the rest,
    whose key is surely not. Joins with ``keys`` then move the first part only."""
    hashed = keys.select(F.xxhash64(column(key)).alias("h"))
    bits = df.sparkSession.sparkContext.broadcast(bit_filter(hashed, "h", log2_bits))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, hashes.to_numpy()))

    test = maybe(F.xxhash64(column(key)))
    return df.filter(test), df.filter(~test)
