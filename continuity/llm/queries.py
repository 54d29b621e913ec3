"""One query per operator, over the whole of its test table, and the pipeline.

The digests that some queries return are derived here from what the operators give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from continuity.llm import (
    bpe,
    chat,
    chunks,
    decontaminate,
    goodness,
    infill,
    maintext,
    pii,
    quality,
    sharding,
    simhash,
    spelling,
    tokencounts,
)


TOKENIZER = "byte_bpe_50k.json"
SHARDS = tuple(f"shard-{k:02d}" for k in range(64))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencounts.count_by_line(documents, public_tokenizers.path(TOKENIZER))
    return tokencounts.line_rows(counted, keep=("doc_id",))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_texts(documents).select(
        "doc_id",
        *[
            f"quality.{name}"
            for name in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
                "n_boilerplate", "n_navigation", "n_punctuation", "lost_chars", "base_failed",
                "kept",
            )
        ],
    )


def _of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(documents, columns=["doc_id"])
    listed = F.transform(
        "pii",
        lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
        ),
    )
    base = F.filter(listed, lambda s: F.substring_index(s, ":", 1).isin(*pii.KINDS))
    return found.select(
        "doc_id",
        *[_of_kind("pii", kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(listed, ",").alias("spans"),
    )


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return maintext.with_main_text(pages).select(
        "page_id",
        "url",
        F.col("main_text").alias("text"),
        F.char_length("main_text").cast("bigint").alias("n_chars"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(documents, "doc_id", SHARDS)


def ids_digest(ids: str) -> Column:
    """Digest of ids in decimal, joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(
        read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)
    )
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        ids_digest("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that overlap."""
    return decontaminate.overlaps(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    ).select("doc_id", "item_id", "start_word", "n_words", "n_equal", "item_words")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated passage that is not the first of its kind."""
    return chunks.repeated_passages(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "end", "n_words", "n_chunks", "source_ids"
    )


def _span_text(spans: str) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation up to its last reply, against the same with the last reply of its
    neighbour (2k and 2k + 1 are neighbours)."""
    turns = read(spark, sf_dir, "conversations")
    formatted = chat.swapped_replies(turns, F.col("conv_id").bitwiseXOR(F.lit(1).cast("bigint")))
    return formatted.withColumns(
        {
            "chosen_spans": _span_text("chosen_spans"),
            "rejected_spans": _span_text("rejected_spans"),
        }
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return infill.fill_in_middle(documents).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(), 256).alias("restored_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of one third of the ids, told by a digest, are not learned from."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out)
    model = goodness.fit(documents, labels)
    return documents.select(
        "doc_id", held_out.alias("held_out"), model.score().alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op4_html": op4_html,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_quality_classifier": op13_quality_classifier,
}
