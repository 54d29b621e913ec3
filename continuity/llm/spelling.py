"""Spelling variants: words of a corpus that differ by one code point, found in a trie.

Every word becomes the vector of its letter-group counts: each code point belongs to one group,
its remainder by the number of groups. One inserted code point raises one count by one, a deleted
one lowers one, a replaced one does both, or neither within a group. Words arranged by successive
counts form a trie; a depth-first search for a word carries a budget of one surplus and one
deficit, follows only children whose count is off by what is left of it, and verifies the words
of the leaves it reaches. (A node with few words below it is a leaf.)

The words are dealt out by their ends: two words that are one edit apart agree in the first half
of the shorter one or in the last half, so every word goes to the bundle of its first letters and
to that of its last, and pairs that agree in both count in the first only. Each bundle gets a trie
of its own. A bundle with more words than ``bundle_words`` is cut into blocks, and each pair of
blocks is a piece of work of its own, so no task holds more than a bounded number of words, however
many end alike. Only words that occur often enough are searched; their table stays distributed.

A word's form is its near word of largest count, if that is ``ratio`` times its own or more (ties:
smallest in code-point order). Counts grow by that factor along a chain of forms, so following
them ends; it is done by doubling the steps.

Defined cases: a null text has no words; a null id counts as empty in the digest of a word; rows
that repeat count as often as they occur; only the id and the text are read, so names of other
columns do not matter; an empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuity.llm.columns import column
from continuity.operators.joins import keyed_join
from continuity.workspace import stored

# Runs of [A-Za-zÀ-ÿ] as UTF-8, after A-Z became a-z.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_NO_LETTER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
# Bytes of a text searched at once, and distinct words kept before they are handed on.
_PIECE = 4 << 20
_KEPT = 200_000


@dataclass(frozen=True)
class SpellingRules:
    """``misspell_one_in``: words of one in so many digests lose a code point (0: none do)."""

    min_chars: int = 6
    min_count: int = 5
    ratio: int = 5
    misspell_one_in: int = 199
    groups: int = 22
    bundle_words: int = 20_000

    @property
    def end_chars(self) -> int:
        """Letters that name a bundle: no more than half of the shortest word."""
        return min(3, self.min_chars // 2)


DEFAULT_RULES = SpellingRules()

# ---- words and how often they occur -------------------------------------------------------


def _pieces(data: bytes) -> Iterator[bytes]:
    """The bytes in pieces, cut where no run goes on."""
    at = 0
    while len(data) - at > _PIECE:
        gap = _NO_LETTER.search(data, at + _PIECE)
        if not gap:
            break
        yield data[at : gap.start()]
        at = gap.start()
    yield data[at:]


def words_of_text(key: int | None, text: str | None, one_in: int) -> Counter[bytes]:
    """The runs of one text, some of them misspelt, with their counts."""
    found: Counter[bytes] = Counter()
    for piece in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        found.update(_RUN.findall(piece))
    if not one_in:
        return found
    words: Counter[bytes] = Counter()
    base = zlib.crc32(b"%s:" % ("" if key is None else str(key)).encode())
    for run, count in found.items():
        digest = zlib.crc32(run, base)
        if digest % one_in == 0:
            letters = run.decode("utf-8")
            gap = digest % len(letters)
            run = (letters[:gap] + letters[gap + 1 :]).encode("utf-8")
        words[run] += count
    return words


def _batch_words(batches: Iterator[pa.RecordBatch], one_in: int) -> Iterator[pa.RecordBatch]:
    kept: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        words = pa.array(list(kept), pa.binary()).cast(pa.string())
        counts = pa.array(list(kept.values()), pa.int64())
        return pa.RecordBatch.from_arrays([words, counts], names=["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            kept.update(words_of_text(key.as_py(), text.as_py(), one_in))
            if len(kept) >= _KEPT:
                yield rows()
                kept.clear()
    if kept:
        yield rows()


def word_counts(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: SpellingRules = DEFAULT_RULES
) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    narrow = df.select(column(doc_id), column(text))
    one_in = rules.misspell_one_in
    counted = narrow.mapInArrow(lambda it: _batch_words(it, one_in), "word string, n bigint")
    long_enough = counted.filter(F.char_length("word") >= rules.min_chars)
    return long_enough.groupBy("word").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= rules.min_count
    )


# ---- the trie -----------------------------------------------------------------------------


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words one after the other, and where each word begins (and the end)."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    return points, starts


def group_counts(words: list[str], groups: int) -> np.ndarray:
    """One row of letter-group counts per word."""
    points, starts = letters_of(words)
    row = np.repeat(np.arange(len(words)), np.diff(starts))
    flat = np.bincount(row * groups + points % groups, minlength=len(words) * groups)
    return flat.reshape(len(words), groups).astype(np.int32)


class Trie:
    """Words in the order of (piece, counts). A node of level k is a range of words that agree
    in the piece and the first k counts; level 0 has one node per piece of work."""

    LEAF = 4
    # States expanded at once; the search goes deeper with one such part before the next.
    PART = 50_000

    def __init__(self, piece: np.ndarray, counts: np.ndarray):
        self.depth = counts.shape[1]
        self.order = np.lexsort((*counts.T[::-1], piece))
        piece, counts = piece[self.order], counts[self.order]
        self.counts = counts
        fresh = np.ones(len(piece), dtype=bool)
        fresh[1:] = piece[1:] != piece[:-1]
        self.first = [np.flatnonzero(fresh)]
        self.pieces = piece[self.first[0]]
        self.radix = int(counts.max(initial=0)) + 3
        # For each level: parent node * radix + count of every node of the next level.
        self.keys = []
        for level in range(self.depth):
            above = np.cumsum(fresh) - 1
            fresh = fresh.copy()
            fresh[1:] |= counts[1:, level] != counts[:-1, level]
            first = np.flatnonzero(fresh)
            self.first.append(first)
            self.keys.append(above[first] * self.radix + counts[first, level])
        self.size = len(piece)

    def _range(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.first[level]
        start = first[node]
        stop = np.append(first, self.size)[node + 1]
        return start, stop

    def search(
        self, piece: np.ndarray, counts: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word of the trie) whose piece is equal and whose counts differ by one
        surplus and one deficit at most."""
        node = np.searchsorted(self.pieces, piece)
        found = node < len(self.pieces)
        found[found] = self.pieces[node[found]] == piece[found]
        query = np.flatnonzero(found)
        one = np.ones(len(query), dtype=np.int8)
        stack = [(0, query, node[query], one, one.copy())]
        while stack:
            level, query, node, more, less = stack.pop()
            if len(query) > self.PART:
                for at in range(0, len(query), self.PART):
                    part = slice(at, at + self.PART)
                    stack.append((level, query[part], node[part], more[part], less[part]))
                continue
            start, stop = self._range(level, node)
            leaf = (stop - start <= self.LEAF) | (level == self.depth)
            if leaf.any():
                yield from self._leaves(query[leaf], start[leaf], stop[leaf], counts)
            inner = ~leaf
            if not inner.any():
                continue
            query, node, more, less = query[inner], node[inner], more[inner], less[inner]
            wanted = counts[query, level]
            below = []
            for step in (0, 1, -1):
                able = more > 0 if step == 1 else less > 0 if step == -1 else slice(None)
                child, hit = self._child(level, node[able], wanted[able] + step)
                below.append(
                    (
                        query[able][hit],
                        child,
                        more[able][hit] - (step == 1),
                        less[able][hit] - (step == -1),
                    )
                )
            joined = [np.concatenate(parts) for parts in zip(*below, strict=True)]
            if len(joined[0]):
                stack.append((level + 1, *joined))

    def _child(
        self, level: int, node: np.ndarray, count: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[level]
        possible = (count >= 0) & (count < self.radix)
        wanted = np.where(possible, node * self.radix + count, -1)
        child = np.searchsorted(keys, wanted)
        hit = child < len(keys)
        hit[hit] = keys[child[hit]] == wanted[hit]
        return child[hit], hit

    def _leaves(
        self, query: np.ndarray, start: np.ndarray, stop: np.ndarray, counts: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All words of the leaves, checked by what their whole vectors differ in."""
        sizes = stop - start
        ends = np.cumsum(sizes)
        at = 0
        while at < len(query):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.PART)))
            part, n = slice(at, upto), sizes[at:upto]
            q = np.repeat(query[part], n)
            word = np.repeat(start[part] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            off = self.counts[word] - counts[q]
            fits = (np.maximum(off, 0).sum(axis=1) <= 1) & (np.minimum(off, 0).sum(axis=1) >= -1)
            yield q[fits], self.order[word[fits]]
            at = upto


# ---- words of the leaves ------------------------------------------------------------------


class Letters:
    """Code points of words, to compare many pairs at once."""

    # Words up to this length are compared as rows of a table, longer ones one by one.
    WIDE = 40

    def __init__(self, words: list[str]):
        self.words = words
        self.points, self.starts = letters_of(words)
        self.lengths = np.diff(self.starts)

    def ends(self, size: int, last: bool) -> np.ndarray:
        """The first or last ``size`` (three at most) code points of each word, as one number."""
        code = np.zeros(len(self.words), dtype=np.int64)
        for k in range(size):
            at = self.starts[1:] - size + k if last else self.starts[:-1] + k
            code = (code << 21) | self.points[at].astype(np.int64)
        return code

    def _rows(self, at: np.ndarray, width: int, pad: int) -> np.ndarray:
        place = np.arange(width)
        inside = place < self.lengths[at][:, None]
        index = np.where(inside, self.starts[at][:, None] + place, 0)
        return np.where(inside, self.points[index].astype(np.int64), pad)

    def one_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs differ by exactly one inserted, deleted or replaced code point."""
        near = np.zeros(len(a), dtype=bool)
        wide = np.maximum(self.lengths[a], self.lengths[b])
        short = wide <= self.WIDE
        same = short & (self.lengths[a] == self.lengths[b])
        for which, longer, shorter in (
            (same, a, b),
            (short & (self.lengths[a] == self.lengths[b] + 1), a, b),
            (short & (self.lengths[b] == self.lengths[a] + 1), b, a),
        ):
            rows = np.flatnonzero(which)
            if not len(rows):
                continue
            width = int(wide[rows].max())
            left = self._rows(longer[rows], width + 1, -1)
            right = self._rows(shorter[rows], width + 1, -1)
            if which is same:
                near[rows] = (left != right).sum(axis=1) == 1
            else:
                # As far as both agree from the front, and from where they agree to the end
                # once the longer one has skipped a code point.
                front = (left != right).argmax(axis=1)
                apart = left[:, 1:] != right[:, :-1]
                last = np.where(apart.any(axis=1), width - apart[:, ::-1].argmax(axis=1), 0)
                near[rows] = last <= front
        for row in np.flatnonzero(~short):
            near[row] = differ_by_one(self.words[a[row]], self.words[b[row]])
        return near


def differ_by_one(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:])


# ---- pieces of work -----------------------------------------------------------------------


PAIR = "word string, n bigint, near string, near_n bigint"


def _near_in(rows: pa.Table, rules: SpellingRules) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of the rows (piece, at_end, side, word, n) of whole pieces of work.
    Side 0 is searched in the trie of side 1; a piece with side 1 only is searched in itself."""
    if not rows.num_rows:
        return
    words = rows.column("word").combine_chunks()
    listed = words.to_pylist()
    letters, counts = Letters(listed), group_counts(listed, rules.groups)
    piece = rows.column("piece").combine_chunks().dictionary_encode().indices
    piece = piece.to_numpy(zero_copy_only=False).astype(np.int64)
    side, at_end = rows.column("side").to_numpy(), rows.column("at_end").to_numpy()
    n = rows.column("n").to_numpy()
    two_sided = np.zeros(piece.max() + 1, dtype=bool)
    two_sided[piece[side == 0]] = True
    held = np.flatnonzero(side == 1)
    asked = np.flatnonzero((side == 0) | ~two_sided[piece])
    begins = letters.ends(rules.end_chars, last=False)
    other = np.where(at_end, begins, letters.ends(rules.end_chars, last=True))
    for query, word in Trie(piece[held], counts[held]).search(piece[asked], counts[asked]):
        a, b = asked[query], held[word]
        # Pairs that agree at both ends belong to the bundle of the first letters.
        fresh = (a != b) & ((at_end[a] == 0) | (other[a] != other[b]))
        a, b = a[fresh], b[fresh]
        near = letters.one_apart(a, b)
        a, b = a[near], b[near]
        mirrored = two_sided[piece[a]]
        a, b = np.r_[a, b[mirrored]], np.r_[b, a[mirrored]]
        if len(a):
            yield pa.RecordBatch.from_arrays(
                [
                    words.take(pa.array(a)),
                    pa.array(n[a], pa.int64()),
                    words.take(pa.array(b)),
                    pa.array(n[b], pa.int64()),
                ],
                names=["word", "n", "near", "near_n"],
            )


def _near_pairs(
    batches: Iterator[pa.RecordBatch], rules: SpellingRules
) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by piece; whole pieces are taken together up to a bounded number of rows."""
    waiting: list[pa.Table] = []
    held = 0
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        held += batch.num_rows
        if held < 2 * rules.bundle_words:
            continue
        rows = pa.concat_tables(waiting)
        pieces = rows.column("piece")
        # The last piece may go on in the next batch.
        whole = pc.index(pieces, pieces[-1]).as_py()
        yield from _near_in(rows.slice(0, whole), rules)
        waiting, held = [rows.slice(whole)], rows.num_rows - whole
    if waiting:
        yield from _near_in(pa.concat_tables(waiting), rules)


def near_words(counted: DataFrame, rules: SpellingRules = DEFAULT_RULES) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of words that differ by one code point.

    ``counted`` has (word, n) with distinct words of ``min_chars`` or more; it is read twice, so
    it should be stored.
    """
    k = rules.end_chars
    ends = [
        F.struct(F.lit(0).alias("at_end"), F.left("word", F.lit(k)).alias("ending")),
        F.struct(F.lit(1).alias("at_end"), F.right("word", F.lit(k)).alias("ending")),
    ]
    sent = counted.select("word", "n", F.inline(F.array(*(ends if k else ends[:1]))))
    bundle = ["at_end", "ending"]
    sizes = sent.groupBy(*bundle).agg(F.count(F.lit(1)).alias("size"))
    full = sizes.filter(F.col("size") > rules.bundle_words).select(
        *bundle, F.ceil(F.col("size") / rules.bundle_words).cast("int").alias("blocks")
    )
    blocks = F.coalesce("blocks", F.lit(1))
    placed = keyed_join(sent, full, bundle, "left", spread_by=["word"]).withColumn("blocks", blocks)
    # Piece (i, j), i <= j, compares block i with block j.
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    pieces = placed.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = pieces.select(
        F.concat_ws(" ", F.col("at_end").cast("string"), "ending", low, high).alias("piece"),
        "at_end",
        F.when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
        "word",
        "n",
    )
    partitions = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(partitions, "piece")
        .sortWithinPartitions("piece")
        .mapInArrow(lambda it: _near_pairs(it, rules), PAIR)
    )


# ---- forms --------------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form: the end of its chain, by doubling the steps."""
    links = stored(forms.select("word", F.col("form").alias("root")), "spelling_links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = links.join(ahead, "root", "left")
        if longer.filter("further is not null").limit(1).count() == 0:
            return links
        links = stored(
            longer.select("word", F.coalesce("further", "root").alias("root")), "spelling_links"
        )


def spelling_variants(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: SpellingRules = DEFAULT_RULES
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    counted = stored(word_counts(df, doc_id, text, rules), "spelling_words")
    near = near_words(counted, rules)
    # Largest count first, then code-point order, which is the order of strings here.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    summed = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    judged = counted.join(summed, "word", "left")
    takes = -F.col("best.less") >= rules.ratio * F.col("n")
    forms = stored(
        judged.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(takes, F.col("best.near")).alias("form"),
            F.when(takes, -F.col("best.less")).alias("form_n"),
        ),
        "spelling_forms",
    )
    roots = _roots(forms.filter("form is not null"))
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
