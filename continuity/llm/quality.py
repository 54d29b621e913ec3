"""Line-first cleaning.

Every line of a text is judged by itself (punctuation, navigation, boilerplate). Lines that
fail are taken out, and a text that loses too much of itself that way is rejected. A second,
plain test looks at the whole text: too few words, or too many words in repeated windows.

All of it is column expressions on one row: no shuffle, no Python.

Defined cases: a null text is an empty one; it has no words, so it fails the base test and is
not kept, and its cleaned text is the empty string. A line without a word is neither judged nor
counted and stays where it is. Repeated rows are judged one by one. Long texts need memory in
proportion to one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuity.llm.columns import chars_in, column, free_name, let, words_of

SYMBOLS = "#*$%&|<>"
# Marks that end a sentence, with a closing quote or bracket after them or not.
SENTENCE_END = "[.!?…。！？][\"'”’»)\\]]*([\\x20\\x09-\\x0D]|$)"
# A word that only separates menu entries, and a mark without which a line has none.
SEPARATOR = "(?<![^\\x20\\x09-\\x0D])(\\||»|›|•|·|→|::|/|>|>>)(?![^\\x20\\x09-\\x0D])"
SEPARATOR_MARK = "[|»›•·→/>:]"
# A word that ends in marks said twice or more, as in shouted lines.
SHOUT = "[!?]{2,}(?![^\\x20\\x09-\\x0D])"
SHOUT_MARK = "[!?][!?]"
# Whole lines that are menu entries.
MENU_LINE = (
    "(?i)^[\\x20\\x09-\\x0D]*(home|menu|search|next|previous|back|back to top|log ?in|log ?out|sign ?in"
    "|sign ?up|register|share|print|contact( us)?|about( us)?|read more|show more|skip to content"
    "|site ?map|subscribe)[.!:]?[\\x20\\x09-\\x0D]*$"
)
# Lower-case phrases of notices that are not prose.
BOILERPLATE = (
    "all rights reserved", "copyright ©", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "accept cookies", "enable javascript",
    "javascript is disabled", "javascript is required", "lorem ipsum",
    "subscribe to our newsletter", "licensed under ", "released under ",
)


@dataclass(frozen=True)
class LineRules:
    """Bounds of the line rules and of the verdict on the whole text."""

    # Longer lines without a sentence end fail; shorter ones may be headings.
    unpunctuated_words: int = 8
    # Longer lines are prose, whatever notice they speak of.
    notice_words: int = 30
    # Percent of a line's words, or of its characters for symbols.
    separator_percent: int = 20
    shout_percent: int = 20
    symbol_percent: int = 10
    # Percent of the characters in words that a text may lose with its failed lines.
    lost_percent: int = 30
    min_words: int = 50
    repeat_percent: int = 50


DEFAULT_RULES = LineRules()


def _line_fault(line: Column, n: Column, chars: Column, rules: LineRules) -> Column:
    """Name of the first rule that a line of ``n`` words and ``chars`` characters in words
    breaks, or null. The counts of marks are taken only where a line has such marks."""
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    shouted = F.regexp_count(line, F.lit(SHOUT))
    return (
        F.when(
            (n <= rules.notice_words)
            & let(F.lower(line), lambda low: _any_of(low, BOILERPLATE)),
            F.lit("boilerplate"),
        )
        .when(
            (
                line.rlike(SEPARATOR_MARK)
                & let(separators, lambda k: (k > 0) & (100 * k >= rules.separator_percent * n))
            )
            | ((n <= 4) & line.rlike(MENU_LINE)),
            F.lit("navigation"),
        )
        .when(
            (100 * chars_in(line, SYMBOLS) > rules.symbol_percent * chars)
            | (
                line.rlike(SHOUT_MARK)
                & let(shouted, lambda k: (k > 1) & (100 * k >= rules.shout_percent * n))
            )
            | ((n >= rules.unpunctuated_words) & ~line.rlike(SENTENCE_END)),
            F.lit("punctuation"),
        )
    )


def _any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def _lines(text: Column, rules: LineRules) -> Column:
    """The lines of a text in order, each with its characters in words and its fault."""

    def one(line: Column) -> Column:
        counts = let(
            words_of(line),
            lambda w: F.struct(
                F.size(w).alias("n"),
                F.char_length(F.array_join(w, "")).alias("chars"),
                w.alias("words"),
            ),
        )
        return let(
            counts,
            lambda c: F.struct(
                line.alias("line"),
                c["chars"].alias("chars"),
                c["words"].alias("words"),
                F.when(c["n"] > 0, _line_fault(line, c["n"], c["chars"], rules)).alias("fault"),
            ),
        )

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one)


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the list.

    Windows are told apart by a 64-bit hash of their words; two different windows of one text
    share one with a chance of about 1 in 10**13 for a text of a thousand words.
    """

    def hashes(w: Column) -> Column:
        hashed = F.transform(w, lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))
        return F.slice(hashed, 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def starts(ordered: Column) -> Column:
        """Positions of windows that equal a neighbour in sorted order."""
        pairs = F.transform(
            ordered,
            lambda s, i: F.when(
                F.get(ordered, i - 1)["h"] == s["h"],
                F.array(F.get(ordered, i - 1)["at"], s["at"]),
            ),
        )
        return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))

    def covered(at: Column) -> Column:
        gaps = F.transform(
            at, lambda a, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - a, F.lit(3)))
        )
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def count(h: Column) -> Column:
        placed = F.arrays_zip(h, F.sequence(F.lit(1), F.size(h)))
        ordered = F.sort_array(placed.cast("array<struct<h:bigint,at:int>>"))
        return F.when(
            F.size(F.array_distinct(h)) < F.size(h), let(let(ordered, starts), covered)
        ).otherwise(F.lit(0))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(let(words, hashes), count))


def judge_texts(
    df: DataFrame,
    text: str = "text",
    rules: LineRules = DEFAULT_RULES,
    out: str = "quality",
) -> DataFrame:
    """``df`` with a struct column ``out``: the figures, the verdict and the cleaned text.

    ``out`` must be a new name; ``columns.free_name`` finds one.
    """
    if out.lower() in {name.lower() for name in df.columns}:
        raise ValueError(f"column exists: {out}")
    source = column(text)
    parts, held = free_name(df, "parts"), free_name(df, "words")
    prepared = df.withColumn(parts, _lines(source, rules))
    prepared = prepared.withColumn(held, F.flatten(column(parts)["words"]))
    whole = F.coalesce(source, F.lit(""))
    lines, words = column(parts), column(held)
    spoken = F.transform(F.filter(lines, lambda x: x["chars"] > 0), lambda x: x["line"])
    failed = F.filter(lines, lambda x: x["fault"].isNotNull())

    def faults(kind: str) -> Column:
        return F.size(F.filter(lines, lambda x: F.coalesce(x["fault"] == kind, F.lit(False))))

    def total(chosen: Column) -> Column:
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda n, x: n + x["chars"])

    figures = F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        chars_in(whole, SYMBOLS).cast("bigint").alias("n_symbols"),
        let(spoken, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        .cast("bigint")
        .alias("n_dup_lines"),
        _repeated_words(words).cast("bigint").alias("n_repeat_words"),
        F.size(spoken).cast("bigint").alias("n_lines"),
        faults("boilerplate").cast("bigint").alias("n_boilerplate"),
        faults("navigation").cast("bigint").alias("n_navigation"),
        faults("punctuation").cast("bigint").alias("n_punctuation"),
        total(failed).alias("lost_chars"),
        F.array_join(
            F.transform(F.filter(lines, lambda x: x["fault"].isNull()), lambda x: x["line"]), "\n"
        ).alias("clean_text"),
    )
    measured = prepared.withColumn(out, figures).drop(parts, held)
    q = column(out)
    base_failed = (q["n_words"] < rules.min_words) | (
        100 * q["n_repeat_words"] > rules.repeat_percent * q["n_words"]
    )
    kept = ~base_failed & (100 * q["lost_chars"] <= rules.lost_percent * q["word_chars"])
    return measured.withColumn(
        out, q.withField("base_failed", base_failed).withField("kept", kept)
    )


def kept_texts(
    df: DataFrame, text: str = "text", rules: LineRules = DEFAULT_RULES, out: str = "quality"
) -> DataFrame:
    """The rows of ``df`` that are kept, with the column ``out`` of ``judge_texts``.

    The verdict is taken through a one-element array: a plain filter would be moved below the
    figures and work them out a second time.
    """
    judged = judge_texts(df, text, rules, out)
    kept = F.filter(F.array(column(out)), lambda q: q["kept"])
    return judged.select(*[column(c) for c in df.columns], F.explode(kept).alias(out))
