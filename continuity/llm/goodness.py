"""Text quality from how well a text compresses with a good and with a bad dictionary.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled
bad. A text is compressed with each, in blocks of fixed size, so that every part of a long text
meets the dictionary afresh and not its own beginning. The difference of the two sizes over their
sum says which dictionary knows the text better. A logistic curve, fitted on labelled texts that
went into neither dictionary, turns it into a chance; it also sees what share of the text is left
after compression, because the difference means little for a text that repeats itself.

The model is fitted on the driver from a sample of fixed size: at most ``rows_per_class`` texts of
a label, those with the smallest hash of their id, each of ``sample_chars`` characters at most.
Every text is scored, whole.

Defined cases: an empty or null text has no difference and a full share, and gets the score that
the curve gives to that; a null id is in no sample; an id whose labels disagree, or a label other
than 0 and 1, is not learned from; of repeated ids one text counts. If a label has too few texts
to build a dictionary of, every score is the share of label 1 (0.5 without any label). Only the
columns named are read, so names of others do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuity.llm.columns import column


@dataclass(frozen=True)
class FitRules:
    """Bounds of the sample and how texts are compressed. ``dictionary_percent`` of the sample
    of a label go into its dictionary, the rest into the curve."""

    rows_per_class: int = 2_000
    sample_chars: int = 10_000
    dictionary_percent: int = 60
    dictionary_bytes: int = 32_768
    block: int = 1_024
    level: int = 3


# Log share of a text below which it mostly repeats itself.
_REPEATS = -1.5


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    constant: float | None = None
    block: int = 1_024
    level: int = 3

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for raw in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(raw)
            dictionary.precompute_compress(level=self.level)
            made.append(
                zstandard.ZstdCompressor(
                    level=self.level,
                    dict_data=dictionary,
                    write_checksum=False,
                    write_content_size=False,
                    write_dict_id=False,
                )
            )
        return made

    def _measured(self, texts: list[str | None]) -> np.ndarray:
        """Difference of the sizes over their sum, and log of the share left, per text."""
        good, bad = self._compressors()
        rows = np.zeros((len(texts), 2))
        for row, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            sizes = [0, 0]
            for at in range(0, len(data), self.block):
                part = data[at : at + self.block]
                sizes[0] += len(good.compress(part))
                sizes[1] += len(bad.compress(part))
            if data:
                total = sizes[0] + sizes[1]
                rows[row] = (sizes[1] - sizes[0]) / total, np.log(total / 2 / len(data))
        return rows

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return _chance(_terms(self._measured(texts)) @ np.array(self.weights))

    def score(self, text: str = "text") -> Column:
        """The score of a column of texts, between 0 and 1."""
        model = self

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(model.scores(batch.tolist()), dtype="float64")

        return scored(column(text))


def _terms(measured: np.ndarray) -> np.ndarray:
    off, share = measured.T
    return np.c_[np.ones(len(off)), off, share, off * share, np.minimum(share - _REPEATS, 0)]


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _curve(terms: np.ndarray, good: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a light ridge on scaled terms."""
    scale = terms.std(axis=0)
    scale[scale == 0] = 1.0
    x = terms / scale
    ridge = np.full(x.shape[1], 0.1)
    ridge[0] = 1e-6
    found = np.zeros(x.shape[1])
    for _ in range(60):
        p = _chance(x @ found)
        slope = x.T @ (weight * (good - p)) - ridge * found
        bend = (x.T * (weight * p * (1 - p))) @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        found = found + step
        if np.abs(step).max() < 1e-9:
            break
    return found / scale


def dictionary_of(texts: list[str], rules: FitRules) -> bytes | None:
    """A zstandard dictionary of the blocks of the texts, None where they are too few."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    blocks = [d[at : at + rules.block] for d in data for at in range(0, len(d), rules.block)]
    try:
        return zstandard.train_dictionary(
            rules.dictionary_bytes, blocks, level=rules.level
        ).as_bytes()
    except zstandard.ZstdError:
        return None


def fit_texts(
    good: list[str], bad: list[str], totals: tuple[int, int], rules: FitRules = FitRules()
) -> CompressionModel:
    """The model of two samples, in their order. ``totals``: how many labels of each kind the
    samples stand for (good, bad)."""
    share = totals[0] / sum(totals) if sum(totals) else 0.5
    parts = []
    for texts in (good, bad):
        cut = len(texts) * rules.dictionary_percent // 100
        parts.append((dictionary_of(texts[:cut], rules), texts[cut:]))
    (good_dictionary, good_rest), (bad_dictionary, bad_rest) = parts
    if good_dictionary is None or bad_dictionary is None or not good_rest or not bad_rest:
        return CompressionModel(b"", b"", (), share, rules.block, rules.level)
    bare = CompressionModel(good_dictionary, bad_dictionary, (), None, rules.block, rules.level)
    terms = _terms(bare._measured(good_rest + bad_rest))
    is_good = np.r_[np.ones(len(good_rest)), np.zeros(len(bad_rest))]
    n = len(is_good)
    weight = np.where(is_good == 1, share * n / len(good_rest), (1 - share) * n / len(bad_rest))
    weights = tuple(float(w) for w in _curve(terms, is_good, weight))
    return CompressionModel(good_dictionary, bad_dictionary, weights, None, rules.block, rules.level)


def fit(
    df: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rules: FitRules = FitRules(),
) -> CompressionModel:
    """Learn from the rows of ``labels`` (1 good, 0 bad) and their texts in ``df``.

    What is broadcast is twice the sample in ids at most, what reaches the driver is the sample.
    """
    agreed = (
        labels.select(column(doc_id).alias("doc_id"), column(label).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
        .select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("place"))
    )
    counted = {r.label: r["count"] for r in agreed.groupBy("label").count().collect()}

    def first(rows: DataFrame, n: int) -> DataFrame:
        """At most ``n`` rows of each label."""
        one, other = (
            rows.filter(F.col("label") == k).orderBy("place", "doc_id").limit(n) for k in (0, 1)
        )
        return one.unionByName(other)

    # Some of them have no text, or one that is too long, so more are looked up than are taken.
    asked = first(agreed, 2 * rules.rows_per_class)
    found = (
        df.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
        .filter(F.char_length("text").between(1, rules.sample_chars))
        .join(F.broadcast(asked), "doc_id")
        .groupBy("doc_id", "label", "place")
        .agg(F.min("text").alias("text"))
    )
    sample = first(found, rules.rows_per_class).orderBy("place", "doc_id").toPandas()
    good, bad = (sample.loc[sample["label"] == k, "text"].tolist() for k in (1, 0))
    return fit_texts(good, bad, (counted.get(1, 0), counted.get(0, 0)), rules)
