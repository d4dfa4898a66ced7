"""The pipeline against its stages done by hand, and its place in the library."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from edges import documents, no_documents
from pyspark.sql import functions as F
from test_quality import brute_counts
from test_simhash import brute_components, brute_fingerprint
from test_spaced_seeds import brute as brute_overlaps
from test_tokens import tiktoken_ids

import __spark_entry__ as entry_points
import corpus_pipeline
from quittance.llm import quality_trees, secret_scan
from quittance.llm.document_stats import FEATURES, statistics
from quittance.llm.queries import QUERIES, quality_model, table

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def by_hand(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, SF_DIR, "documents").collect())
    trees = quality_model(spark, SF_DIR)
    kept = []
    for d, t in docs:
        n_words, _, _, _, repeats = brute_counts(t)
        judged = np.array([statistics(t)])[:, [FEATURES.index(f) for f in quality_trees.JUDGED]]
        if n_words >= 10 and 100 * repeats <= 20 * n_words and trees.probability(judged)[0] >= 0.5:
            kept.append((d, t))
    ids = [d for d, _ in kept]
    roots = brute_components(ids, [brute_fingerprint(t) for _, t in kept])
    kept = [x for x, root in zip(kept, roots, strict=True) if x[0] == root]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF_DIR, "benchmark").collect()]
    words = {i: set(t.split()) for i, t in items}
    near = [(d, t) for d, t in kept if any(len(w & set(t.split())) >= 5 for w in words.values())]
    dirty = {d for d, _, _ in brute_overlaps(near, items)}
    kept = [(d, t) for d, t in kept if d not in dirty]
    encode, out = tiktoken_ids(), {}
    for d, t in kept:
        text = secret_scan.masked(t, secret_scan.scan(t)[1])
        found = encode(text)
        digest = hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest()
        out[d] = (len(found), digest, hashlib.sha256(text.encode()).hexdigest())
    return len(docs), out


def test_pipeline_is_its_stages(spark):
    total, expected = by_hand(spark)
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows}
    assert got == expected and len(rows) == len(got)
    assert 0.5 * total < len(got) < total


def test_stages_bear_odd_rows(spark):
    docs = documents(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF_DIR)
        assert stage(spark, no_documents(spark), SF_DIR).count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns
        assert found.count() <= docs.count()


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES])
def test_stages_hand_workers_small_batches(spark, stage):
    key, most = "spark.sql.execution.arrow.maxBytesPerBatch", corpus_pipeline.BATCH_BYTES
    before, size = spark.conf.get(key, None), 100_000
    docs = spark.range(0, 100, 1, 1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), size).alias("text"), F.lit(size).cast("long").alias("n_chars")
    )

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    try:
        for bound, largest in ((None, most + 2 * size), (5 * size, 7 * size)):
            spark.conf.set(key, str(bound)) if bound else spark.conf.unset(key)
            stage(spark, docs, SF_DIR)
            found = [r["size"] for r in docs.mapInArrow(sizes, "size long").collect()]
            assert len(found) > 1 and max(found) <= largest and sum(found) > 100 * size
            assert spark.conf.get(key) == str(bound or most)  # a session's own bound stays
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_the_queries_are_registered():
    names = entry_points.queries().keys()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert QUERIES.keys() <= names and "pipeline" in names


def test_nothing_else_imports_the_text_operators():
    for f in [*ROOT.glob("quittance/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in f.parts:
            assert not re.search(r"import.*\bllm\b|\bllm\b.*import", f.read_text()), f


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_entry_module_works_without_the_text_operators(tmp_path, pipeline):
    """A copy of the repository without the two folders still registers every other query."""
    copy = tmp_path / "repo"
    files = [*ROOT.glob("quittance/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "__spark_entry__.py"]
    for f in [*files, *[ROOT / "corpus_pipeline.py"] * pipeline]:
        if "llm" not in f.parts:
            there = copy / f.relative_to(ROOT)
            there.parent.mkdir(parents=True, exist_ok=True)
            there.write_bytes(f.read_bytes())
    code = (
        f"import sys; sys.path.insert(0, {str(copy)!r}); import __spark_entry__ as e; "
        "assert 'quittance.llm' not in sys.modules and 'corpus_pipeline' not in sys.modules; "
        "assert not any(q.startswith('op') for q in e.queries()); print(e.__file__, len(e.queries()))"
    )
    env = os.environ | {"PYTHONPATH": str(ROOT)}  # what the copy lacks must not come from here
    command = [sys.executable, "-B", "-c", code]
    done = subprocess.run(command, cwd=copy, capture_output=True, text=True, env=env)
    assert done.returncode == 0, done.stderr
    file, count = done.stdout.rsplit(maxsplit=1)
    assert Path(file).parent == copy
    assert int(count) == len(entry_points.queries()) - len(QUERIES) - 1
