"""The registered queries of this subpackage: each applies one operator, as in production, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, licenses, paragraph_dedup, quality, segment, simhash, suffix_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_index(spark: SparkSession) -> exact_dedup.DigestIndex:
    """An index of its own for one run, so that runs do not see each other's texts."""
    return exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")


def op1_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.sample_segmentations(table(spark, sf_dir, "documents"))
    return segment_digests(found)


def segment_digests(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"), "rank", F.size("ids").cast("long").alias("n_pieces"), "log_p", F.col("value").alias("perturbed"), "log_inclusion", "round_trip", F.xxhash64("ids").alias("ids_hash")
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "score", "posterior", "votes", "keep")


def op4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraph_dedup.paragraph_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_paragraphs", "n_repeated", "component_ids", "n_short_repeated", "short_component_ids", "n_removed", F.size("spans").cast("long").alias("n_spans"), "spans")


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = new_index(spark)
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), index)
    index.drop()
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), clean=False)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_segmentations, op2_simhash, op3_quality, op4_paragraphs, op5_exact, op6_suffixes, op7_warc, op8_chats, op9_licenses, op10_decontaminate)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The other operators have no SQL form; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_exact": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS target FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN target <> page_id THEN target END AS refers_to
        FROM g""",
}
