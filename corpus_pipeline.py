"""A training corpus from raw documents, in five stages.

Each stage is written as Parquet in the shared folder and read again by the next one, so a lost
executor costs one stage at most, and every stage can be looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from continuity.llm import bpe, decontaminate, pii, quality, simhash
from continuity.llm.columns import column, free_name
from continuity.workspace import run_folder

TOKENIZER = "byte_bpe_50k.json"
SHINGLE_WORDS = 3
MAX_DISTANCE = 2


def _with_text(docs: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns with another text, and ``n_chars``, where there is one, as long as it."""
    changed = {"text": text, "n_chars": F.char_length(text).cast("bigint")}
    return docs.select(
        *[changed[c].alias(c) if c in changed else column(c) for c in columns]
    )


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go from every document, rejected documents go."""
    mark = free_name(docs, "quality")
    kept = quality.kept_texts(docs, "text", out=mark)
    return _with_text(kept, docs.columns, column(mark)["clean_text"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return simhash.one_per_component(docs, shingle=SHINGLE_WORDS, radius=MAX_DISTANCE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_overlaps(docs, benchmark)


def pii_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes labels, terms that disclose it are generalised or removed."""
    return _with_text(pii.sanitised(docs), docs.columns, column("text"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of what the ids decode to."""
    encoded = bpe.encode_texts(docs, public_tokenizers.path(TOKENIZER))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", pii_removal),
    ("bpe", bpe_tokens),
]

# SQL has no BPE: run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents."""
    folder = run_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
