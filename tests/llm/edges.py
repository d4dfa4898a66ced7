"""Rows that operators must bear: missing values, odd texts, repeats, clashing column names."""

from __future__ import annotations

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997} Ärger" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the quiet river bank today."),
    (2, "The quick brown fox jumps over the lazy dog near the quiet river bank today."),
    (3, None),
    (4, ""),
    (5, " \t\r\n\x0b\x0c "),
    (None, "a row without an id, and its own words"),
    (None, None),
    (6, LONG),
    (7, "été naïve 🙂 中文字   x<|endoftext|>y"),
    (8, "repeated row"),
    (8, "repeated row"),
    (8, "another text under the same id"),
    (-9, "a negative id"),
]
#: Names that operators use for columns of their own.
CLASHING = (
    "ids decoded starts ends fp text_hash component_id chosen words hash region at low start size "
    "slot shard n_tokens n_bytes kept score spans base label stats id doc nth _nth _id _hash digest "
    "position grp bucket tab payload first member content path n"
).split()


def documents(spark, rows=None):
    df = spark.createDataFrame(TEXTS if rows is None else rows, "doc_id bigint, text string")
    df = df.select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def no_documents(spark):
    return documents(spark).where("false")
