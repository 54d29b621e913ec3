"""Token counts by offset-mapped attribution.

A document is encoded once, whole: a token at the border of two sections is then the token that
training sees. Every token has a span of characters; the spans are joined with the sections'
intervals, and a token that crosses a border goes to one section by an explicit rule:

* ``most``: the section with most of its characters, the earlier one where they are equal;
* ``first``: the section with its first character;
* ``last``: the section with its last character.

So the counts of the sections of a text, and of what lies outside all sections, add up to the
count of the text. A token of a few bytes of one character has that character's span.

Defined cases: a null text is an empty one. The sections of a text must be in order and
disjoint; an empty section gets no token. Rows are independent of each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuity.llm.codec import Codec, load
from continuity.llm.columns import column

RULES = ("most", "first", "last")


def token_spans(codec: Codec, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First characters and ends (exclusive) of the tokens of a text."""
    ids = codec.encode(text)
    lengths = codec.byte_lengths[ids]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if len(text) != (ends[-1] if len(ends) else 0):
        data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        # Characters begun up to and with each byte.
        begun = np.cumsum((data & 0xC0) != 0x80)
        return begun[starts] - 1, begun[ends - 1]
    return starts, ends


def attribute(
    starts: np.ndarray,
    ends: np.ndarray,
    begins: np.ndarray,
    stops: np.ndarray,
    rule: str = "most",
) -> tuple[np.ndarray, np.ndarray]:
    """For each token the section it goes to, -1 for none, and whether it crosses a border.

    Sections without characters are passed over.
    """
    real = np.flatnonzero(stops > begins)
    lows, highs = begins[real], stops[real]
    if not len(real) or not len(starts):
        return np.full(len(starts), -1), np.zeros(len(starts), dtype=bool)
    if np.any(lows[1:] < highs[:-1]):
        raise ValueError("sections must be in order and disjoint")
    # Sections that share a character with a token are lo up to hi.
    lo = np.searchsorted(highs, starts, side="right")
    hi = np.searchsorted(lows, ends, side="left")
    touched = hi - lo
    owner = np.where(touched > 0, lo, -1)
    at = np.flatnonzero(touched > 0)
    inside = np.zeros(len(starts), dtype=bool)
    inside[at] = (lows[lo[at]] <= starts[at]) & (ends[at] <= highs[lo[at]])
    crossing = (touched > 0) & ~inside
    for token in np.flatnonzero(crossing):
        sections = np.arange(lo[token], hi[token])
        if rule == "most":
            shares = np.minimum(highs[sections], ends[token]) - np.maximum(
                lows[sections], starts[token]
            )
            # What lies outside all sections is a share like others, and loses a tie.
            rest = ends[token] - starts[token] - shares.sum()
            best = int(np.argmax(shares))
            owner[token] = sections[best] if shares[best] >= rest else -1
        else:
            place = starts[token] if rule == "first" else ends[token] - 1
            held = (lows[sections] <= place) & (place < highs[sections])
            owner[token] = sections[held][0] if held.any() else -1
    return np.where(owner >= 0, real[owner], -1), crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Every line with its line feed is a section: together they are the text."""
    ends = np.cumsum([len(line) + 1 for line in text.split("\n")])
    ends[-1] -= 1
    return np.r_[0, ends[:-1]], ends


def count_by_line(
    df: DataFrame, path: str, text: str = "text", out: str = "lines", rule: str = "most"
) -> DataFrame:
    """``df`` with a column ``out``: for each line of ``text`` in order its start and end in
    characters, its tokens, and how many of them cross a border.

    ``path``: a tokenizers file of kind byte-level BPE, read on the driver.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}")
    if out.lower() in {name.lower() for name in df.columns}:
        raise ValueError(f"column exists: {out}")
    vocabulary = load(path)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary.ranks, vocabulary.special))
    held: list[Codec] = []

    @F.pandas_udf("starts array<int>, ends array<int>, tokens array<int>, crossing array<int>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        if not held:
            held.append(Codec(*shared.value))
        rows = []
        for value in texts:
            value = value or ""
            begins, stops = line_sections(value)
            owner, crossing = attribute(*token_spans(held[0], value), begins, stops, rule)
            n = len(begins)
            rows.append(
                (
                    begins.astype(np.int32),
                    stops.astype(np.int32),
                    np.bincount(owner[owner >= 0], minlength=n).astype(np.int32),
                    np.bincount(owner[(owner >= 0) & crossing], minlength=n).astype(np.int32),
                )
            )
        return pd.DataFrame(rows, columns=["starts", "ends", "tokens", "crossing"])

    return df.withColumn(out, counted(column(text)))


def line_rows(df: DataFrame, lines: str = "lines", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per line of what ``count_by_line`` gives: the columns in ``keep`` and line,
    start_char, end_char, n_tokens, n_crossing."""
    one = column(lines)
    zipped = F.arrays_zip(one["starts"], one["ends"], one["tokens"], one["crossing"]).cast(
        "array<struct<start_char:int,end_char:int,n_tokens:int,n_crossing:int>>"
    )
    rows = df.select(*[column(k) for k in keep], F.posexplode(zipped).alias("line", "counted"))
    return rows.select(*[column(k) for k in keep], "line", "counted.*")
