"""Information-theoretic sanitisation.

Personal data of four plain kinds (email, ip, card, phone) is found by pattern. Secrets (keys,
tokens, passwords) are found by what they are: a value that something is set to (``name = value``,
``name: "value"``) whose characters are too many and too mixed to be a word or a name, told by their
entropy and by how often neighbours change between digits and letters. These are the
protected entities, each value by itself and each kind as a whole. Other words may reveal them:
what a word tells about an entity is the pointwise mutual information of the two, estimated
from how often they stand together in the corpus. With

* N words outside the mentions in all, n(t) of them the term t,
* n(e) words within ``window`` words of a mention of the entity e on the same line, and
* n(t, e) of those the term t,

PMI(t, e) = log2(N n(t, e) / (n(t) n(e))) and the information of the entity is
IC(e) = log2(N / n(e)). A term whose PMI reaches ``generalise`` of the information of an entity
stands for it in most places and is replaced by a label of the entity's kind; one that reaches
``remove`` gives the entity away and is cut out. Estimates from few places say nothing: a term
counts only if it stands near the entity in ``min_contexts`` different contexts (neighbouring
words other than the entity), so copies of one document prove nothing.

The corpus is read three times (mentions and their neighbours; counts of the candidate terms;
sanitisation). Terms and counts are tables; a bit map of fixed size lets the tasks pass over
words that are surely not candidates. No statistic is capped or sampled.

Defined cases: a null text is an empty one: no spans, sanitised text null. Rows that repeat are
treated each, and count each in the statistics except for ``min_contexts``. An empty corpus has
no terms.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuity.llm.bits import bit_filter, split_by_keys
from continuity.llm.columns import column, free_name
from continuity.operators.joins import keyed_join
from continuity.workspace import stored

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the four kinds; the extra anchors only save time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")
# Terms are words of letters.
_TERM = re.compile(r"[^\W\d_]{3,}")

SECRET = "secret"
# A value that is set to: after a sign, perhaps quoted.
_ASSIGNED = re.compile(r"[=:][\x20\t]{0,3}[\"'`]?([A-Za-z0-9+_-][A-Za-z0-9+/_-]{15,}={0,2})")
_CHANGE = re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
_NAMED = re.compile(r"[A-Za-z0-9_\])][\"'`]?[\x20\t]{0,3}\Z")

LABELS = {
    "email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", SECRET: "[SECRET]",
}
Span = tuple[str, int, int]


@dataclass(frozen=True)
class Disclosure:
    """Bounds of the statistics."""

    window: int = 10
    min_contexts: int = 3
    # Share of an entity's information that a term may tell.
    generalise: float = 0.90
    remove: float = 0.97
    # A secret has so many bits by its own characters, and a change between digit and letter once
    # in so many characters. Measured on planted values (``tests/llm/test_pii.py``).
    secret_bits: float = 48.0
    secret_change: int = 14


DEFAULT_DISCLOSURE = Disclosure()


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @; walking from each is linear where the plain pattern is not."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if k % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Spans of the four kinds, by kind as listed, then start; ends are exclusive."""
    if not text:
        return []
    found: list[Span] = []
    if "@" in text:
        found += [("email", s, e) for s, e in _emails(text)]
    if not _DIGITS.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _is_secret(value: str, rules: Disclosure) -> bool:
    counts = Counter(value)
    n = len(value)
    bits = -sum(c * math.log2(c / n) for c in counts.values())
    if bits < rules.secret_bits:
        return False
    changes = len(_CHANGE.findall(value))
    return changes > 2 and changes * rules.secret_change >= n


def secret_spans(text: str | None, rules: Disclosure = DEFAULT_DISCLOSURE) -> list[Span]:
    """Values that are secrets, in order."""
    if not text:
        return []
    return [
        (SECRET, m.start(1), m.end(1))
        for m in _ASSIGNED.finditer(text)
        if _NAMED.search(text, max(0, m.start() - 5), m.start()) and _is_secret(m[1], rules)
    ]


def entity_spans(text: str | None, rules: Disclosure = DEFAULT_DISCLOSURE) -> list[Span]:
    """All protected entities: base spans, then secrets."""
    return base_spans(text) + secret_spans(text, rules)


def _value(kind: str, text: str) -> str:
    """An entity's value, however it is written."""
    if kind == "email":
        return text.lower()
    return text if kind in ("ip", SECRET) else re.sub("[^0-9]", "", text)


def term_hash(term: str) -> int:
    """Hash of a term for the bit map."""
    data = term.encode("utf-8", "replace")
    return zlib.crc32(data) | (len(data) & 0x7FFF) << 32


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    """The texts of a batch, a few hundred at a time in memory."""
    for start in range(0, batch.num_rows, 512):
        yield from batch.column(0).slice(start, 512).to_pylist()


def _hashed(terms: Column) -> Column:
    @F.pandas_udf("bigint")
    def hashed(values: pd.Series) -> pd.Series:
        return pd.Series([term_hash(t) for t in values], dtype="int64")

    return hashed(terms)


def _mentions(
    batches: Iterator[pa.RecordBatch], rules: Disclosure
) -> Iterator[pa.RecordBatch]:
    """One row for each entity, term near a mention of it and context, with how often.

    A word near several mentions of one entity counts once. ``term`` null: words of any kind
    near the entity.
    """
    for batch in batches:
        counts: Counter = Counter()
        for text in _texts(batch):
            spans = entity_spans(text, rules)
            if not spans:
                continue
            near: dict[str, dict[int, tuple[str, int]]] = {}
            line_words: dict[int, list] = {}
            for kind, start, end in spans:
                begin = text.rfind("\n", 0, start) + 1
                if begin not in line_words:
                    stop = text.find("\n", begin)
                    stop = len(text) if stop < 0 else stop
                    line_words[begin] = _outside(_TERM.finditer(text, begin, stop), spans)
                words = line_words[begin]
                place = _bisect(words, start)
                window = words[max(0, place - rules.window) : place + rules.window]
                terms = [m[0].lower() for m in window]
                context = zlib.crc32(" ".join(terms).encode("utf-8", "replace"))
                for entity in (kind, f"{kind}:{_value(kind, text[start:end])}"):
                    seen = near.setdefault(entity, {})
                    for m, term in zip(window, terms, strict=True):
                        seen.setdefault(m.start(), (term, context))
            for entity, seen in near.items():
                counts.update((entity, term, context) for term, context in seen.values())
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k, _ in rows], pa.string()),
                pa.array([k[1] for k, _ in rows], pa.string()),
                pa.array([k[2] for k, _ in rows], pa.int64()),
                pa.array([n for _, n in rows], pa.int64()),
            ],
            names=["entity", "term", "context", "n"],
        )


def _outside(words: Iterator[re.Match], spans: list[Span]) -> list[re.Match]:
    """The words, in order, that touch none of the spans."""
    blocked = sorted((s, e) for _, s, e in spans)
    kept, at, reach = [], 0, -1
    for word in words:
        while at < len(blocked) and blocked[at][0] < word.end():
            reach = max(reach, blocked[at][1])
            at += 1
        if word.start() >= reach:
            kept.append(word)
    return kept


def _bisect(words: list, start: int) -> int:
    """How many of the words begin before ``start``."""
    low, high = 0, len(words)
    while low < high:
        middle = (low + high) // 2
        if words[middle].start() < start:
            low = middle + 1
        else:
            high = middle
    return low


def _term_counts(
    batches: Iterator[pa.RecordBatch], bits: np.ndarray, rules: Disclosure
) -> Iterator[pa.RecordBatch]:
    """Per batch, how often each possible candidate occurs outside spans; null: all words."""
    mask = len(bits) * 8 - 1
    for batch in batches:
        counts: Counter = Counter()
        for text in _texts(batch):
            spans = entity_spans(text, rules)
            if spans:
                counts.update(m[0].lower() for m in _outside(_TERM.finditer(text), spans))
            elif text:
                counts.update(map(str.lower, _TERM.findall(text)))
        kept = [
            (t, n)
            for t, n in counts.items()
            if bits[(h := term_hash(t) & mask) >> 3] >> (h & 7) & 1
        ]
        kept.append((None, sum(counts.values())))
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())],
            names=["term", "n"],
        )


def disclosing_terms(
    df: DataFrame, text: str = "text", rules: Disclosure = DEFAULT_DISCLOSURE
) -> DataFrame:
    """(term, kind, action, share) of the terms that reveal an entity, each with its worst case."""
    spark = df.sparkSession
    texts = df.select(column(text).alias("text")).filter(F.col("text").isNotNull())
    near = texts.mapInArrow(
        lambda it: _mentions(it, rules), "entity string, term string, context bigint, n bigint"
    )
    # Two aggregates: copies fold into contexts, contexts into pairs; a hot entity or term is
    # summed on the map side first.
    contexts = stored(
        near.groupBy("entity", "term", "context").agg(F.sum("n").alias("n")), "contexts"
    )
    pairs = contexts.groupBy("entity", "term").agg(
        F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("contexts")
    )
    entities = contexts.groupBy("entity").agg(F.sum("n").alias("n_entity"))
    candidates = stored(pairs.filter(F.col("contexts") >= rules.min_contexts), "candidates")
    bits = spark.sparkContext.broadcast(
        bit_filter(candidates.select("term").distinct().select(_hashed(F.col("term")).alias("h")), "h")
    )
    counted = stored(
        texts.mapInArrow(lambda it: _term_counts(it, bits.value, rules), "term string, n bigint")
        .groupBy("term")
        .agg(F.sum("n").alias("n_term")),
        "terms",
    )
    total = counted.filter(F.col("term").isNull()).select(F.col("n_term").alias("n_all"))
    # One row: the number of words in the corpus.
    n_all = (total.first() or [0])[0]
    measured = keyed_join(
        keyed_join(candidates, counted.filter(F.col("term").isNotNull()), ["term"]),
        entities,
        ["entity"],
    )
    pmi = F.log2(
        F.lit(float(n_all)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity").cast("double"))
    )
    information = F.log2(F.lit(float(n_all)) / F.col("n_entity"))
    told = measured.withColumn("share", pmi / information).filter(
        (information > 0) & (F.col("share") >= rules.generalise)
    )
    kind = F.substring_index("entity", ":", 1)
    return (
        told.groupBy("term")
        .agg(F.max(F.struct("share", kind.alias("kind"))).alias("worst"))
        .select(
            "term",
            F.col("worst.kind").alias("kind"),
            F.when(F.col("worst.share") >= rules.remove, "remove").otherwise("generalise").alias("action"),
            F.col("worst.share").alias("share"),
        )
    )


def _found(
    batches: Iterator[pd.DataFrame], bits: np.ndarray, rules: Disclosure
) -> Iterator[pd.DataFrame]:
    """The entities of each text, and its words that may be disclosing terms."""
    mask = len(bits) * 8 - 1
    some = bool(bits.any())
    known: dict[str, bool] = {}
    for batch in (b.iloc[k : k + 512] for b in batches for k in range(0, len(b), 512)):
        spans, terms = [], []
        for text in batch["text"]:
            base = entity_spans(text, rules)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            words = []
            if some and text:
                for m in _outside(_TERM.finditer(text), base):
                    word = m[0].lower()
                    hit = known.get(word)
                    if hit is None:
                        h = term_hash(word) & mask
                        hit = known[word] = bool(bits[h >> 3] >> (h & 7) & 1)
                    if hit:
                        words.append({"term": word, "start": m.start(), "end": m.end()})
                if len(known) > 1_000_000:
                    known.clear()
            terms.append(words)
        yield pd.DataFrame({"doc_key": batch["doc_key"].array, "spans": spans, "terms": terms})


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_TOLD = "array<struct<kind:string,start:int,end:int,about:string>>"


def find_spans(
    df: DataFrame, text: str = "text", rules: Disclosure = DEFAULT_DISCLOSURE
) -> DataFrame:
    """(doc_key, spans) of every different text: the base spans, secrets, then disclosing terms
    of kind ``generalise`` or ``remove`` with the kind of data they tell of in ``about``.
    ``doc_key`` is the digest of the text."""
    spark = df.sparkSession
    texts = df.select(column(text).alias("text")).filter(F.col("text").isNotNull())
    terms = stored(disclosing_terms(df, text, rules), "disclosing")
    bits = spark.sparkContext.broadcast(bit_filter(terms.select(_hashed(F.col("term")).alias("h")), "h"))
    keyed = texts.select(F.md5(F.col("text").cast("binary")).alias("doc_key"), "text")
    found = stored(
        keyed.mapInPandas(
            lambda it: _found(it, bits.value, rules),
            f"doc_key string, spans {_SPANS}, terms array<struct<term:string,start:int,end:int>>",
        ),
        "found",
    )
    words = found.filter(F.size("terms") > 0).select("doc_key", F.explode("terms").alias("w"))
    words = words.select("doc_key", "w.term", "w.start", "w.end").distinct()
    told = keyed_join(words, terms, ["term"], spread_by=["doc_key", "start"])
    span = F.struct(
        F.col("action").alias("kind"), "start", "end", F.col("kind").alias("about")
    )
    per_text = told.groupBy("doc_key").agg(F.sort_array(F.collect_list(span)).alias("told"))
    base = F.transform("spans", lambda s: s.withField("about", s["kind"]))
    once = found.groupBy("doc_key").agg(F.first("spans").alias("spans"))
    return once.join(per_text, "doc_key", "left").select(
        "doc_key", F.concat(base, F.coalesce("told", F.array().cast(_TOLD))).alias("spans")
    )


def sanitise_text(text: str | None, spans) -> str | None:
    """The text with base spans and generalised terms replaced by labels, removed terms cut out.

    Where spans overlap, the one that starts first stands for all it touches.
    """
    if text is None or spans is None or not len(spans):
        return text
    out, done = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] < done:
            if span["end"] > done:
                done = span["end"]
            continue
        out.append(text[done : span["start"]])
        if span["kind"] != "remove":
            out.append(LABELS[span["about"]])
        done = span["end"]
    out.append(text[done:])
    return "".join(out)


def with_spans(
    df: DataFrame,
    text: str = "text",
    out: str = "pii",
    rules: Disclosure = DEFAULT_DISCLOSURE,
    columns: list[str] | None = None,
) -> DataFrame:
    """``columns`` of ``df`` (all, if not said) and ``out``: the spans of ``text``, empty where
    there are none."""
    columns = df.columns if columns is None else columns
    if out.lower() in {name.lower() for name in df.columns}:
        raise ValueError(f"column exists: {out}")
    key = free_name(df, "doc_key")
    digest = F.md5(column(text).cast("binary")).alias(key)
    keyed = df.select(*[column(c) for c in columns], digest)
    spans = stored(find_spans(df, text, rules), "spans").filter(F.size("spans") > 0)
    spans = spans.select(F.col("doc_key").alias(key), F.col("spans").alias(out))
    none = F.array().cast(_TOLD)
    # Only rows that may have spans are moved.
    maybe, without = split_by_keys(keyed, key, spans)
    joined = maybe.join(spans, key, "left").withColumn(out, F.coalesce(column(out), none))
    return joined.unionByName(without.withColumn(out, none)).select(
        *[column(c) for c in columns], column(out)
    )


def sanitised(
    df: DataFrame, text: str = "text", rules: Disclosure = DEFAULT_DISCLOSURE
) -> DataFrame:
    """``df`` with personal data and disclosing terms taken out of ``text``."""
    mark = free_name(df, "pii")
    marked = with_spans(df, text, mark, rules)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([sanitise_text(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    cleaned = F.when(F.size(column(mark)) > 0, clean(column(text), column(mark)))
    return marked.withColumn(text, cleaned.otherwise(column(text))).select(
        *[column(c) for c in df.columns]
    )
