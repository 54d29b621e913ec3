"""Repeated passages by content-defined chunking.

A gear rolling hash runs over the bytes of a text: h = 2 h + G[byte] in 16 bits, so the last 16
bytes decide. Where its top bits are zero, and the chunk has its least length, a chunk ends.
Cuts depend on what stands there and not on where: an insertion moves the cuts near it, behind
it they fall as before. Chunks are told apart by a 128-bit digest. A digest that occurs again
is a repeat; its first place (smallest id, then place in the text) is the original. Runs of
neighbouring repeats with enough words are repeated passages.

A passage loses the piece before its first cut and after its last one, a chunk's length each on
average; ``min_words`` is lower than the passages that are sought by that much.

How it runs: digests are counted with a map-side sum, which a digest of millions of places does
not burden; only the places of digests that occur twice or more are kept, and runs are made
within a text. Pairs name the first place only: their number is linear in the chunks.

Defined cases: null and empty texts have no chunks. Rows that repeat an id and a text are one
document; texts that share an id are told apart by ``text_hash``. Null ids come first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from continuity.llm.bits import bit_filter, passes
from continuity.llm.columns import column
from continuity.workspace import stored

_WIDTH = 16


def _gear() -> np.ndarray:
    """A fixed random number for each byte."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 1) & 0xFFFF for b in range(256)], np.uint16)


@dataclass(frozen=True)
class Cuts:
    """Lengths in bytes, and the words of a repeated passage."""

    least: int = 8
    most: int = 512
    # Top bits of the hash that must be zero: a cut every 2**bits bytes behind the least length.
    bits: int = 5
    min_words: int = 16


DEFAULT_CUTS = Cuts()


def rolling_hash(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The gear hash behind every byte, by doubling the stretch it covers."""
    h = gear[data]
    width = 1
    while width < _WIDTH:
        moved = np.zeros_like(h)
        moved[width:] = h[:-width] << np.uint16(width)
        h = h + moved
        width *= 2
    return h


def cut_points(data: np.ndarray, gear: np.ndarray, cuts: Cuts = DEFAULT_CUTS) -> list[int]:
    """Ends of the chunks, in bytes. No chunk ends within a character."""
    n = len(data)
    if not n:
        return []
    at_start = np.ones(n + 1, dtype=bool)
    at_start[:n] = (data & 0xC0) != 0x80
    marked = rolling_hash(data, gear) >> np.uint16(16 - cuts.bits) == 0
    ends = np.flatnonzero(marked & at_start[1:]) + 1
    out, start = [], 0
    for end in [*ends.tolist(), n]:
        while end - start > cuts.most:
            forced = start + cuts.most
            while not at_start[forced]:
                forced -= 1
            out.append(forced)
            start = forced
        if end - start >= cuts.least or end == n:
            if end > start:
                out.append(end)
            start = end
    return out


def _chunk_rows(batches: Iterator[pa.RecordBatch], cuts: Cuts) -> Iterator[pa.RecordBatch]:
    gear = _gear()
    # A few hundred texts at a time keep the lists of their chunks small.
    for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
        rows, begins, ends, words, high, low = [], [], [], [], [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            raw = text.encode("utf-8", "replace")
            data = np.frombuffer(raw, dtype=np.uint8)
            stops = cut_points(data, gear, cuts)
            if not stops:
                continue
            stops = np.array(stops)
            starts = np.r_[0, stops[:-1]]
            # Characters, and starts of words, before every byte.
            begun = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            space = (data == 32) | ((data >= 9) & (data <= 13))
            word = np.r_[0, np.cumsum(~space & np.r_[True, space[:-1]])]
            for s, e in zip(starts.tolist(), stops.tolist(), strict=True):
                digest = xxhash.xxh3_128_digest(raw[s:e])
                high.append(digest[:8])
                low.append(digest[8:])
            rows.append(np.full(len(stops), row))
            begins.append(begun[starts])
            ends.append(begun[stops])
            words.append(word[stops] - word[starts])
        none = [np.zeros(0, np.int32)]
        chosen = pa.array(np.concatenate(rows or none))
        number = lambda parts: np.frombuffer(b"".join(parts), dtype="<i8")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(chosen),
                batch.column(1).take(chosen),
                pa.array(np.concatenate(begins or none), pa.int32()),
                pa.array(np.concatenate(ends or none), pa.int32()),
                pa.array(np.concatenate(words or none), pa.int32()),
                pa.array(number(high), pa.int64()),
                pa.array(number(low), pa.int64()),
            ],
            names=["doc_id", "text_hash", "start", "end", "words", "high", "low"],
        )


def chunks(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", cuts: Cuts = DEFAULT_CUTS
) -> DataFrame:
    """Every chunk: doc_id, text_hash, start and end in characters, the words that start in it,
    and its digest in two halves."""
    texts = df.select(
        column(doc_id).alias("doc_id"), F.xxhash64(column(text)).alias("text_hash"), column(text).alias("text")
    )
    key = texts.schema["doc_id"].dataType.simpleString()
    return texts.filter(F.col("text").isNotNull()).mapInArrow(
        lambda it: _chunk_rows(it, cuts),
        f"doc_id {key}, text_hash bigint, start int, end int, words int, high bigint, low bigint",
    )


def repeated_passages(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", cuts: Cuts = DEFAULT_CUTS
) -> DataFrame:
    """One row per repeated passage that is not the first of its kind: doc_id, text_hash, start
    and end in characters, n_words, n_chunks, and the ids where its chunks stood first."""
    every = stored(chunks(df, doc_id, text, cuts), "chunks")
    place = F.struct("doc_id", "text_hash", "start")
    # Each repeated digest with its first place: combined on the map side, so a digest with very
    # many places is one row per task.
    firsts = stored(
        every.groupBy("high", "low")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .filter("n > 1")
        .select("high", "low", "first"),
        "firsts",
    )
    bits = df.sparkSession.sparkContext.broadcast(bit_filter(firsts, "high"))

    @F.pandas_udf("boolean")
    def maybe(high: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, high.to_numpy()))

    # Both sides are written tables, and only chunks that may be repeated are moved: Spark can
    # split a digest with very many places.
    later = (
        every.filter(maybe("high"))
        .join(firsts, ["high", "low"])
        .filter(~place.eqNullSafe(F.col("first")))
        .select("doc_id", "text_hash", "start", "end", "words", F.col("first.doc_id").alias("source"))
    )
    # A text's own chunks: as many as it is long.
    of_text = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    begins = F.coalesce(F.col("start") > F.lag("end").over(of_text), F.lit(True))
    run = F.sum(begins.cast("int")).over(of_text)
    return (
        later.distinct()
        .withColumn("run", run)
        .groupBy("doc_id", "text_hash", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("words").alias("n_words"),
            F.count(F.lit(1)).alias("n_chunks"),
            F.array_sort(F.collect_set("source")).alias("source_ids"),
        )
        .filter(F.col("n_words") >= cuts.min_words)
        .drop("run")
    )


def without_repeats(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", cuts: Cuts = DEFAULT_CUTS
) -> DataFrame:
    """(doc_id, text) with repeated passages cut out; the first of each stays."""
    spans = repeated_passages(df, doc_id, text, cuts).groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")
    )
    texts = df.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(spans["doc_id"]) & (hashed["text_hash"] == spans["text_hash"])
    joined = hashed.join(spans, same, "left").select(hashed["doc_id"], hashed["text"], "spans")
    length = F.char_length("text")
    # What stands between one span's end and the next one's start.
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    stops = F.concat(F.transform("spans", lambda s: s["start"]), F.array(length))
    kept = F.zip_with(starts, stops, lambda a, b: F.substring(F.col("text"), a + 1, b - a))
    return joined.select(
        "doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "")).alias("text")
    )
