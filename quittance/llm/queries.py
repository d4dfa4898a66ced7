"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.llm import (
    alignment,
    byte_bpe,
    conversation_repair,
    html_blocks,
    quality_trees,
    rank_merges,
    secret_scan,
    sharding,
    simhash,
    spaced_seeds,
    token_counts,
    token_files,
    warc,
)
from quittance.session import work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _base32(digest: str) -> str:
    """SQL for the base32 form of a SHA-1 in hex: ten hex digits make eight characters."""
    alphabet = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    chunks = [f"CAST('0x' || substr({digest}, {k}, 10) AS BIGINT)" for k in (1, 11, 21, 31)]
    return " || ".join(
        f"substr({alphabet}, CAST(({chunk} >> {shift}) & 31 AS BIGINT) + 1, 1)"
        for chunk in chunks
        for shift in range(35, -1, -5)
    )


#: SQL for the one query that it can express; it has neither tokenizers nor fingerprints nor models,
#: and no way back from codes. ``tests/llm`` holds the others against brute-force versions.
ORACLES: dict[str, str] = {
    "op7_warc": f"""
WITH payloads AS (SELECT page_id, COALESCE(html, '') AS payload FROM pages),
known AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS digest,
         MIN(page_id) OVER (PARTITION BY payload) AS first
  FROM payloads)
SELECT page_id, payload_bytes, {_base32("digest")} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM known""".strip()
}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@_query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "tokens")
    tokenizer = tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))
    token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer, folder, end_id=1)
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@_query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
        "layers",
        "finished",
    )


@_query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4, seed=42)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def bpe_round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids, and digests of the ids and of the bytes they decode to)."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokenizer = byte_bpe.tokenizer_from_ranks(ranks, public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(docs.select("doc_id", "text"), tokenizer, round_trip=True)
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents")).drop("ids")


@_query
def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), n_shards=40)


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokenizer_text(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer, limit=512)


@_query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    records, _ = warc.read_archives(spark, folder, whole=True)  # what was just written has no gaps
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every aligned overlap of a document with a benchmark item."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return spaced_seeds.overlaps(docs, benchmark).drop("text_hash")


#: Labelled rows that the quality trees are fitted to at most.
TRAINING_ROWS = 20_000


def quality_model(spark: SparkSession, sf_dir: str) -> quality_trees.Trees:
    """Trees fitted to the labelled documents of the given tables."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_trees.fit(*quality_trees.labelled_statistics(docs, labels, TRAINING_ROWS))


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.quality_rules(
        table(spark, sf_dir, "documents"), quality_model(spark, sf_dir)
    )


@_query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(table(spark, sf_dir, "pages"))


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_digests(damaged, gone="gone")


@_query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tokenizer_text(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        b = f.read()
    aligned = alignment.alignments(table(spark, sf_dir, "documents"), a, b, digest=True)
    return alignment.scored(aligned, a, b).withColumnRenamed("groups", "groups_sha256")


@_query
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rank_merges.encode(docs, tokenizer, round_trip=True).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
