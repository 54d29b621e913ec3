"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over neighbouring words: some positions count, the others may hold any
word. Every place of every benchmark item and of every document is hashed under each mask, the
hashes are joined, and around each hit the document and the item are laid side by side on the
hit's diagonal and compared word by word. An overlap is a stretch of aligned words that is long
enough and in which few words differ.

The default masks skip nothing that the comparison accepts: whichever words of an overlap differ,
one of the six masks (6 words each, 7 to 10 long) lies on equal words only. That holds for every
overlap of every length and is tested by exhaustion, not by sampling. Other masks or bounds may
lose overlaps; ``most_missed`` tells.

Items of up to 15 words overlap also as a whole, when ``equal_percent`` of all their words stand
on the diagonal, at their edges or not. Items of fewer than ``whole_below`` words say little and
must be found whole, every word of them; their seed is the whole item, and documents are hashed in
its length. No item is too short to be searched.

How it runs: benchmark hashes stay a table. Two bit maps of bounded size (``bits``) let a task that
reads documents throw away places that surely hit nothing; what passes is joined with the
table. Pairs of document and item, with all their diagonals, are then one row each; only their
documents are read again for the comparison, whose cost is one item's length for each diagonal.

Words are compared in lower case (A-Z) and without leading or trailing marks.

Defined cases: null texts and texts without words match nothing. Repeated rows, of documents or
of the benchmark, are each compared; a document with a null id is found like others. Items with
equal ids are told apart by their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuity.llm.bits import bit_filter, passes, split_by_keys
from continuity.llm.columns import column, free_name
from continuity.operators.joins import keyed_join
from continuity.workspace import stored

MARKS = b".,;:!?\"'()[]{}<>*#$%&|-_=+~`/\\"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Search:
    """Seeds and the test of an overlap."""

    # 1: the word counts, 0: any word.
    masks: tuple[str, ...] = (
        "1111011", "11110011", "11011101", "10101111", "110010111", "1110100011",
    )
    # The words of a stretch that are an overlap.
    overlap_words: int = 13
    # Percent of the words of a stretch that must be equal.
    equal_percent: int = 80
    # Items of fewer words must be found whole, without a differing word.
    whole_below: int = 8

    def percent(self, item_words: int) -> int:
        return self.equal_percent if item_words >= self.whole_below else 100

    def seeds(self, short: tuple[int, ...]) -> list[tuple[int, str]]:
        """Salts and masks for documents, ``short``: lengths of items that are searched whole."""
        return [*enumerate(self.masks), *((1000 + n, "1" * n) for n in short)]

    def seeds_of_item(self, n_words: int) -> list[tuple[int, str]]:
        return self.seeds((n_words,))[-1:] if n_words < self.whole_below else self.seeds(())


DEFAULT_SEARCH = Search()


def words_of_text(text: str | None) -> list[bytes]:
    """Words in lower case, without marks at either end; words of marks only are left out."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [w for w in (p.strip(MARKS) for p in parts) if w]


class _Known(dict):
    """Hashes of raw words in lower case, 0 for marks only; a bounded memory of them."""

    def __missing__(self, part: bytes) -> int:
        word = part.strip(MARKS)
        value = (xxhash.xxh64_intdigest(word) or 1) if word else 0
        if len(part) <= 40:
            if len(self) >= 200_000:
                self.clear()
            self[part] = value
        return value


def text_hashes(text: str | None, known: _Known) -> np.ndarray:
    """Hashes of the words of a text, as ``words_of_text`` has them."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashed = np.fromiter(map(known.__getitem__, parts), dtype=np.uint64, count=len(parts))
    return hashed[hashed != 0]


def seed_hashes(hashed: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of every place of a text under one mask; ``salt`` keeps masks apart."""
    n = len(hashed) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, salt + 1, dtype=np.uint64)
    for k, counts in enumerate(mask):
        if counts == "1":
            total *= _MULTIPLIER
            total += hashed[k : k + n]
    return total


def most_missed(search: Search, n_words: int, edges: bool) -> int:
    """The fewest differing words with which a stretch of ``n_words`` hits no mask; ``edges``:
    whether its first and last word may differ. Masks lose nothing when this is more than the
    comparison allows."""
    span = max(map(len, search.masks))
    seeds = [int(m, 2) for m in search.masks]
    hits = [any(state & seed == seed for seed in seeds) for state in range(1 << span)]
    # The last words, 1 where equal: fewest differing words so far.
    best = {0: 0}
    for at in range(n_words):
        then: dict[int, int] = {}
        for state, n in best.items():
            for equal in (1,) if not edges and at in (0, n_words - 1) else (0, 1):
                now = (state << 1 | equal) & ((1 << span) - 1)
                if not hits[now]:
                    then[now] = min(then.get(now, n_words), n + 1 - equal)
        best = then
    return min(best.values(), default=n_words + 1)


def _item_rows(batches: Iterator[pd.DataFrame], search: Search) -> Iterator[pd.DataFrame]:
    known = _Known()
    for batch in batches:
        made = []
        for key, text in zip(batch["item_key"], batch["text"], strict=True):
            hashed = text_hashes(text, known)
            if not len(hashed):
                continue
            whole = len(hashed) if len(hashed) < search.whole_below else 0
            for salt, mask in search.seeds_of_item(len(hashed)):
                h = seed_hashes(hashed, mask, salt)
                made.append(
                    pd.DataFrame(
                        {
                            "item_key": key,
                            "item_at": np.arange(len(h)),
                            "h": h.view(np.int64),
                            "whole": whole,
                        }
                    )
                )
        yield pd.concat(made) if made else pd.DataFrame(
            {"item_key": [], "item_at": [], "h": [], "whole": []}
        )


def _groups(
    batch: pa.RecordBatch, known: _Known, words: int = 1 << 15
) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Keys and word hashes of the texts of a batch, some ten thousand words at a time."""
    keys, hashed, n = [], [], 0
    for first in range(0, batch.num_rows, 256):
        part = batch.slice(first, 256)
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            keys.append(key)
            hashed.append(text_hashes(text, known))
            n += len(hashed[-1])
            if n >= words:
                yield keys, hashed
                keys, hashed, n = [], [], 0
    if keys:
        yield keys, hashed


def _hits(
    batches: Iterator[pa.RecordBatch],
    seeds: list[tuple[int, str]],
    bits: tuple[np.ndarray, np.ndarray],
) -> Iterator[pa.RecordBatch]:
    """Places of documents that may hit: (doc_key, at, h)."""
    low, high = bits
    known = _Known()
    for batch in batches:
        keys, places, found = [], [], []
        for names, texts in _groups(batch, known):
            joined = np.concatenate(texts)
            ends = np.cumsum([len(t) for t in texts])
            for salt, mask in seeds:
                h = seed_hashes(joined, mask, salt)
                at = np.flatnonzero(passes(low, h))
                at = at[passes(high, h[at] >> np.uint64(32))]
                text = np.searchsorted(ends, at, side="right")
                whole = at + len(mask) <= ends[text]
                at, text = at[whole], text[whole]
                keys += [names[k] for k in text]
                places.append(at - np.r_[0, ends][text])
                found.append(h[at].view(np.int64))
        empty = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.string()),
                pa.array(np.concatenate(places or empty), pa.int32()),
                pa.array(np.concatenate(found or empty), pa.int64()),
            ],
            names=["doc_key", "at", "h"],
        )


def best_stretch(equal: np.ndarray, search: Search, item_words: int) -> tuple[int, int, int]:
    """(start, length, equal words) of the longest stretch of aligned words that is an overlap,
    or zeros. A stretch starts and ends with an equal word. Where enough words of the whole item
    are equal, the stretch from the first to the last of them is one, too."""
    need = min(search.overlap_words, item_words)
    p = search.percent(item_words)
    # A stretch has p percent equal words when its sum of (100 if equal else 0) - p is not
    # negative: for each end, the earliest start with a prefix sum no higher.
    sums = np.r_[0, np.cumsum(np.where(equal, 100, 0) - p)]
    low = np.minimum.accumulate(sums)
    best = (0, 0, 0)
    for end in np.flatnonzero(equal) + 1:
        start = int(np.searchsorted(-low, -sums[end], side="left"))
        while start < end and not equal[start]:
            start += 1
        if end - start >= need and end - start > best[1]:
            best = (start, int(end - start), int(equal[start:end].sum()))
    same = np.flatnonzero(equal)
    if not best[1] and len(same) and 100 * len(same) >= p * item_words:
        best = (int(same[0]), int(same[-1] - same[0] + 1), len(same))
    return best


def _verify(batches: Iterator[pd.DataFrame], search: Search) -> Iterator[pd.DataFrame]:
    """The longest stretch of each pair of document and item over all its diagonals; of equally
    good ones the first."""
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            document, item = words_of_text(row.text), words_of_text(row.item_text)
            best = (0, 0, 0)
            for diagonal in sorted(row.diagonals):
                first = max(0, -diagonal)
                last = min(len(item), len(document) - diagonal)
                equal = np.array(
                    [item[k] == document[k + diagonal] for k in range(first, last)], dtype=bool
                )
                start, length, same = best_stretch(equal, search, len(item))
                best = max(best, (length, same, -(start + first + int(diagonal))))
            if best[0]:
                rows.append((row.doc_key, row.item_key, -best[2], best[0], best[1], len(item)))
        yield pd.DataFrame(
            rows, columns=["doc_key", "item_key", "start_word", "n_words", "n_equal", "item_words"]
        )


def overlaps(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    search: Search = DEFAULT_SEARCH,
) -> DataFrame:
    """One row per document and item that overlap: doc_id, doc_key, item_id, and of the longest
    stretch start_word, n_words, n_equal, besides item_words. ``doc_key`` is the digest of the
    document's text."""
    spark = documents.sparkSession
    items = benchmark.select(
        column(item_id).alias("item_id"), column(item_text).alias("item_text")
    ).filter(F.col("item_text").isNotNull())
    items = items.withColumn("item_key", F.md5(F.col("item_text").cast("binary")))
    texts = items.groupBy("item_key").agg(F.first("item_text").alias("item_text"))
    seeds = stored(
        texts.select("item_key", F.col("item_text").alias("text")).mapInPandas(
            lambda it: _item_rows(it, search), "item_key string, item_at int, h bigint, whole int"
        ),
        "seeds",
    )
    # Lengths of items that are searched whole, fewer than ``whole_below``.
    short = sorted(r.whole for r in seeds.filter("whole > 0").select("whole").distinct().collect())
    searched = search.seeds(tuple(short))
    bits = spark.sparkContext.broadcast(
        (
            bit_filter(seeds, "h"),
            bit_filter(seeds.select(F.shiftrightunsigned("h", 32).alias("h")), "h"),
        )
    )
    narrow = documents.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    keyed = narrow.filter(F.col("text").isNotNull()).withColumn(
        "doc_key", F.md5(F.col("text").cast("binary"))
    )
    hits = keyed.select("doc_key", "text").mapInArrow(
        lambda it: _hits(it, searched, bits.value), "doc_key string, at int, h bigint"
    )
    candidates = stored(
        keyed_join(stored(hits, "hits"), seeds, ["h"])
        .select("doc_key", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal"))
        .groupBy("doc_key", "item_key")
        .agg(F.collect_set("diagonal").alias("diagonals")),
        "candidates",
    )
    # Only texts that may be wanted are moved.
    wanted = candidates.select("doc_key").distinct()
    maybe, _ = split_by_keys(keyed.select("doc_key", "text"), "doc_key", wanted)
    found_texts = (
        maybe.join(wanted, "doc_key", "left_semi")
        .groupBy("doc_key")
        .agg(F.first("text").alias("text"))
    )
    side_by_side = candidates.join(found_texts, "doc_key").join(texts, "item_key")
    longest = stored(
        side_by_side.select("doc_key", "item_key", "diagonals", "text", "item_text").mapInPandas(
            lambda it: _verify(it, search),
            "doc_key string, item_key string, start_word int, n_words int, n_equal int, item_words int",
        ),
        "overlaps",
    )
    rows = keyed_join(keyed.select("doc_id", "doc_key"), longest, ["doc_key"], "inner")
    return rows.join(items.select("item_id", "item_key"), "item_key").select(
        "doc_id", "doc_key", "item_id", "start_word", "n_words", "n_equal", "item_words"
    )


def without_overlaps(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    search: Search = DEFAULT_SEARCH,
) -> DataFrame:
    """The documents that overlap no benchmark item, as they are."""
    mark = free_name(documents, "doc_key")
    keyed = documents.withColumn(mark, F.md5(column(text).cast("binary")))
    found = overlaps(documents, benchmark, doc_id, text, search=search)
    found = stored(found.select(F.col("doc_key").alias(mark)).distinct(), "overlapping")
    maybe, clean = split_by_keys(keyed, mark, found)
    return clean.unionByName(maybe.join(found, mark, "left_anti")).select(
        *[column(name) for name in documents.columns]
    )
