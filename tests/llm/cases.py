"""Rows that every operator must take: nulls, empty and long texts, copies, clashing names."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, "
    "quality string, fp string, doc_key string, text_hash string, pii string, spans string, "
    "words string, parts string, copies string, shard string, slot string, lines string"
)
CLASHES = SCHEMA.count(",") - 4

WORDS = "river stone under bright morning people walk slowly over long roads while birds sing".split()


def prose(seed: int, words: int, line: int = 12) -> str:
    rng = random.Random(seed)
    picked = [rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) + str(rng.randint(0, 99)) for _ in range(words)]
    lines = [" ".join(picked[k : k + line]) + "." for k in range(0, words, line)]
    return "\n".join(lines)


def texts() -> list[str | None]:
    shared = prose(7, 70)
    return [
        None,
        "",
        " \t\n\x0b ",
        "one",
        "two words",
        "héllo wörld 漢字 🙂 çà",
        prose(1, 80),
        prose(1, 80),
        prose(2, 400),
        prose(3, 60) + "\n" + shared,
        shared + "\n" + prose(4, 60),
        "same same same same " * 40,
        "home | about | contact | more\n" * 12 + prose(5, 55),
        "a" * 50_000,
        prose(6, 6_000),
        "x <|endoftext|> y " + prose(8, 60),
    ]


def documents(spark, rows: list[tuple[int | None, str | None]] | None = None):
    """The rows (id, text), by default all cases with repeated and null ids."""
    if rows is None:
        rows = list(enumerate(texts()))
        rows += [rows[6], rows[9], (None, prose(9, 60)), (None, None), (3, prose(10, 60))]
    made = [(i, t, "en", "s", len(t or ""), *["clash"] * CLASHES) for i, t in rows]
    return spark.createDataFrame(made, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
