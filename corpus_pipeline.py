"""The corpus pipeline: from raw documents to token ids, stage by stage.

Each stage reads all documents its predecessor kept. Its result is written as Parquet to the
cluster's shared folder and read again, so a later stage never repeats an earlier one and a lost
executor costs tasks, not stages.

The Python workers of an executor live on from stage to stage, and so do the buffers that Spark
fills for them. Rows are therefore handed to them in small batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quittance.llm import quality_trees, secret_scan, simhash, spaced_seeds
from quittance.llm.queries import bpe_round_trip, quality_model, table
from quittance.llm.shared import stored

#: Bytes of rows handed to a Python worker at once. By Spark's own bound of 64 MB whole input splits
#: are, and each lies in the executor and in the worker several times over.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """``stage`` with the session's batches bounded, unless the session has a bound of its own.

    The setting stays, as a stage's rows are only made when its result is written.
    """

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_BATCH_SETTING, None) is None:
            spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return bounded


@small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees; the others go."""
    return quality_trees.keep_good(docs, quality_model(spark, sf_dir))


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash.keep_one(docs, simhash.near_duplicates(docs, words=4, radius=4, seed=42))


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text of the benchmark; those that hold some go."""
    found = spaced_seeds.overlaps(docs, table(spark, sf_dir, "benchmark"))
    return spaced_seeds.keep_clean(docs, found)


@small_batches
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in them masked."""
    return secret_scan.mask_secrets(docs)


@small_batches
def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with digests of the ids and of the text decoded from them."""
    return bpe_round_trip(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL has neither the trees nor the fingerprints nor the tokenizer; ``tests/llm`` holds the
#: pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
