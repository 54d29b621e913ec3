"""BPE encoding and decoding, with tree concatenation for long texts.

A text of ordinary length is encoded whole in the task that reads it. A long text is cut into
leaves by halving; the leaves are dealt to all tasks, encoded there, and put together as a tree.
At every join a window around it is encoded again and grows until both sides agree:

* The split into pretokens runs from left to right and looks at most three characters behind a
  match. A start of a pretoken on the left side that is further than that from the join is
  therefore a start in the whole text. The window begins at the last such start and grows to
  the right until its split meets a start of the right side; from there on both are the same.
* A pretoken that runs across the join (text without any split may be as long as it likes) is
  not encoded anew in full: the ``k`` last ids of its left part and the ``k`` first ids of its
  right part are joined and encoded again, with ``k`` doubled until the first and the last id
  of that window are those of the two parts. Every pair of neighbours then is as BPE makes it,
  and a sequence all of whose neighbours are so is the encoding of the whole.

Strings of special tokens in a text become special tokens, as in the tokenizers library; a text
is cut at them first.

Defined cases: a null text is an empty one and gives no ids. Rows that repeat are encoded each;
long ones once, and repeated in the result. Ids may be null or equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from continuity.llm.codec import LOOK_AHEAD, Codec, load
from continuity.llm.columns import column

# Characters from which a text is long, and of the largest leaf of its tree.
LONG_CHARS = 32_768
LEAF_CHARS = 16_384
# Rows of one batch that a task hands back.
OUT_ROWS = 256
# Ids on either side of a join that the first window takes.
FIRST_WINDOW = 8

# A leaf or a part of the tree: its text, the starts of its pretokens, and their ids.
Part = tuple[str, list[int], list[list[int]]]


def encode_leaf(codec: Codec, text: str) -> Part:
    """Pretokens of a text without special tokens, and the ids of each."""
    starts, ids = [], []
    for match in codec.pretoken.finditer(text):
        starts.append(match.start())
        ids.append(codec.encode_piece(match[0].encode("utf-8", "replace")))
    return text, starts, ids


def join_ids(codec: Codec, left: list[int], right: list[int]) -> list[int]:
    """Ids of the bytes of two unsplit parts put together."""
    if not left or not right:
        return left + right
    k = FIRST_WINDOW
    while True:
        a, b = left[-k:], right[:k]
        again = codec.encode_piece(codec.engine.decode_bytes(a + b))
        at_start, at_end = len(a) == len(left), len(b) == len(right)
        if (at_start or again[0] == a[0]) and (at_end or again[-1] == b[-1]) and (
            len(again) > 1 or (at_start and at_end)
        ):
            return left[: len(left) - len(a)] + again + right[len(b) :]
        k *= 2


def join_parts(codec: Codec, left: Part, right: Part) -> Part:
    """The part of both texts put together."""
    (a, a_starts, a_ids), (b, b_starts, b_ids) = left, right
    if not a or not b:
        return left if a else right
    keep = len(a_starts) - 1
    while keep > 0 and a_starts[keep] + LOOK_AHEAD > len(a):
        keep -= 1
    begin = a_starts[keep]
    known = {start: k for k, start in enumerate(b_starts)}
    reach = 64
    while True:
        whole = reach >= len(b)
        window = a[begin:] + b[:reach]
        starts, met = [], None
        for match in codec.pretoken.finditer(window):
            at = match.start() + begin - len(a)
            if at in known and (whole or match.start() + LOOK_AHEAD <= len(window)):
                met = at
                break
            if not whole and match.end() + LOOK_AHEAD > len(window):
                break
            starts.append(match.start())
        if met is not None or whole:
            break
        reach *= 2
    end = len(a) + met if met is not None else len(a) + len(b)
    resumed = known[met] if met is not None else len(b_starts)
    bounds = [*(s + begin for s in starts), end]
    ids = []
    for s, e in zip(bounds, bounds[1:], strict=False):
        ids.append(_across(codec, left, right, s, e))
    moved = [s + len(a) for s in b_starts[resumed:]]
    return (
        a + b,
        [*a_starts[:keep], *bounds[:-1], *moved],
        [*a_ids[:keep], *ids, *b_ids[resumed:]],
    )


def _across(codec: Codec, left: Part, right: Part, start: int, end: int) -> list[int]:
    """Ids of the pretoken from ``start`` to ``end`` of the joined text."""
    (a, a_starts, a_ids), (b, b_starts, b_ids) = left, right
    if start < len(a) < end and start == a_starts[-1]:
        last = 0
        while last + 1 < len(b_starts) and b_starts[last + 1] < end - len(a):
            last += 1
        stops = b_starts[last + 1] if last + 1 < len(b_starts) else len(b)
        if last == 0 and stops == end - len(a):
            return join_ids(codec, a_ids[-1], b_ids[0])
    piece = a[start:end] if end <= len(a) else a[start:] + b[max(0, start - len(a)) : end - len(a)]
    return codec.encode_piece(piece.encode("utf-8", "replace"))


def join_tree(codec: Codec, parts: list[Part]) -> Part:
    """Put leaves together, neighbours first."""
    while len(parts) > 1:
        paired = [
            join_parts(codec, parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k]
            for k in range(0, len(parts), 2)
        ]
        parts = paired
    return parts[0]


def leaves_of(text: str, leaf_chars: int) -> list[str]:
    """A text cut into halves until no piece is longer than a leaf."""
    if len(text) <= leaf_chars:
        return [text]
    middle = len(text) // 2
    return leaves_of(text[:middle], leaf_chars) + leaves_of(text[middle:], leaf_chars)


def _sections(codec: Codec, text: str) -> list[str]:
    """A text cut at the strings of special tokens, which stay as sections of their own."""
    if not codec.special:
        return [text]
    longest_first = sorted(codec.special, key=len, reverse=True)
    return [s for s in re.split("(" + "|".join(map(re.escape, longest_first)) + ")", text) if s]


def _leaf_rows(
    batches: Iterator[pa.RecordBatch], codec: Codec, leaf_chars: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            key, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            made = [
                (key, section, leaf, part)
                for section, words in enumerate(_sections(codec, text))
                for leaf, part in enumerate(
                    [words] if words in codec.special else leaves_of(words, leaf_chars)
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[1] for m in made], pa.int32()),
                    pa.array([m[2] for m in made], pa.int32()),
                    pa.array([m[3] for m in made], pa.string()),
                ],
                names=["key", "section", "leaf", "part"],
            )


def _leaf_ids(batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, sizes, ids = [], [], []
        for text in batch.column(3).to_pylist():
            if text in codec.special:
                starts.append([0])
                sizes.append([1])
                ids.append([codec.special[text]])
                continue
            _, at, each = encode_leaf(codec, text)
            starts.append(at)
            sizes.append([len(x) for x in each])
            ids.append([i for x in each for i in x])
        numbers = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array(starts, numbers),
                pa.array(sizes, numbers),
                pa.array(ids, numbers),
            ],
            names=["key", "section", "leaf", "part", "starts", "sizes", "ids"],
        )


def _joined(codec: Codec, group: pd.DataFrame) -> pd.DataFrame:
    """The ids of one long text from those of its leaves."""
    ids: list[int] = []
    for _, section in group.sort_values(["section", "leaf"]).groupby("section"):
        parts = []
        for text, starts, sizes, flat in zip(
            section["part"], section["starts"], section["sizes"], section["ids"], strict=True
        ):
            cuts = np.cumsum(sizes)[:-1]
            each = [x.tolist() for x in np.split(np.asarray(flat), cuts)]
            parts.append((text, np.asarray(starts).tolist(), each))
        if len(parts) == 1 and parts[0][0] in codec.special:
            ids.append(codec.special[parts[0][0]])
        else:
            ids += [i for each in join_tree(codec, parts)[2] for i in each]
    return pd.DataFrame(
        {"key": [group["key"].iloc[0]], "ids": [ids], "decoded": [codec.decode(ids)]}
    )


def _whole_texts(batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[pa.RecordBatch]:
    """Ids and decoded texts, in batches small enough for their arrays to be small."""
    for batch in batches:
        for start in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(start, OUT_ROWS)
            ids = [codec.encode(t) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                    pa.array([codec.decode(i) for i in ids], pa.string()),
                ],
                names=["doc_id", "ids", "decoded"],
            )


def encode_texts(
    df: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    long_chars: int = LONG_CHARS,
    leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """(doc_id, ids, decoded): ids of every text and what they decode to, one row per row.

    ``path``: a tokenizers file of kind byte-level BPE, read on the driver and sent to the
    tasks; its size does not depend on the data.
    """
    spark = df.sparkSession
    vocabulary = load(path)
    shared = spark.sparkContext.broadcast((vocabulary.ranks, vocabulary.special))
    held: list[Codec] = []

    def codec() -> Codec:
        """One codec for each task."""
        if not held:
            held.append(Codec(*shared.value))
        return held[0]

    narrow = df.select(
        column(doc_id).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text")
    )
    result = T.StructType(
        [
            T.StructField("doc_id", narrow.schema["doc_id"].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
        ]
    )
    is_long = F.char_length("text") > long_chars
    short = narrow.filter(~is_long).mapInArrow(lambda it: _whole_texts(it, codec()), result)

    # Copies of a long text are encoded once. The key is the text's digest.
    long_rows = narrow.filter(is_long).withColumn("key", F.sha2("text", 256))
    owners = long_rows.select("doc_id", "key")
    texts = long_rows.groupBy("key").agg(F.first("text").alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = texts.mapInArrow(
        lambda it: _leaf_rows(it, codec(), leaf_chars),
        "key string, section int, leaf int, part string",
    ).repartition(partitions, "key", "section", "leaf")
    encoded = leaves.mapInArrow(
        lambda it: _leaf_ids(it, codec()),
        "key string, section int, leaf int, part string, starts array<int>, sizes array<int>, "
        "ids array<int>",
    )

    joined = encoded.groupBy("key").applyInPandas(
        lambda group: _joined(codec(), group), "key string, ids array<int>, decoded string"
    )
    return short.unionByName(owners.join(joined, "key").select("doc_id", "ids", "decoded"))
