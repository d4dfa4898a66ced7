from __future__ import annotations

import zlib
from collections import Counter

import pytest
from edges import TEXTS, documents, no_documents
from pyspark.sql import functions as F

from quittance.llm.queries import QUERIES, table
from quittance.llm.sharding import shards

SF_DIR = "/root/testdata/sf0.001"


def check(rows, n_shards):
    """Counts at most one apart, slots without gaps; returns the rows per shard."""
    held = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(held.get(s, [])) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    return sizes


@pytest.mark.parametrize("n_shards", [1, 3, 40])
def test_odd_rows(spark, n_shards):
    rows = shards(documents(spark), n_shards).collect()
    check(rows, n_shards)
    expected = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in TEXTS]
    got = [(r["doc_id"], r["size"], r["text_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert shards(no_documents(spark), n_shards).count() == 0


def groups(spark, sizes):
    """A document for every place in groups of the given sizes."""
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize(
    ("sizes", "n_shards"),
    [
        ([1] * 300 + [2] * 60 + [5] * 20, 10),
        ([300] + [1] * 600, 9),
        ([40] * 25, 10),
        ([1000], 7),
        ([3] * 200, 5),
    ],
)
def test_neighbours_come_together(spark, sizes, n_shards):
    df = groups(spark, sizes)
    rows = shards(df, n_shards).join(df, "doc_id").collect()
    check(rows, n_shards)
    together = start = 0
    for n, count in Counter((r["text"], r["shard"]) for r in rows).items():
        together += count * count
    for n in sizes:
        low, more = divmod(n, n_shards)
        start += more * (low + 1) ** 2 + (n_shards - more) * low * low
    room = len(rows) // n_shards
    best = sum((n // room) * room * room + (n % room) ** 2 if n > room else n * n for n in sizes)
    assert together >= start
    if len(sizes) > 1:  # most links that can be whole are whole; fewer if nobody can make way
        assert together - start >= (0.6 if 1 in sizes else 0.3) * (best - start)


def test_links_may_be_given(spark):
    df = spark.createDataFrame([(k, f"text {k}", f"site {k % 4}") for k in range(40)], "doc_id bigint, text string, site string")
    rows = shards(df, 4, rounds=12, link=F.col("site")).join(df, "doc_id").collect()
    check(rows, 4)
    assert sum(n * n for n in Counter((r["site"], r["shard"]) for r in rows).values()) > 4 * 4 * 7


def test_query(spark):
    rows = table(spark, SF_DIR, "documents").collect()
    got = QUERIES["op5_shards"](spark, SF_DIR).collect()
    check(got, 40)
    texts = {r["doc_id"]: r["text"].encode() for r in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {
        d: (len(t) + 16, zlib.crc32(t)) for d, t in texts.items()
    }
    shard = {r["doc_id"]: r["shard"] for r in got}
    copies = {}
    for d, t in texts.items():
        copies.setdefault(t, []).append(shard[d])
    whole = [len(set(s)) == 1 for s in copies.values() if 1 < len(s) <= len(rows) // 40]
    assert whole and sum(whole) / len(whole) > 0.9


def test_no_python_runs(spark):
    plan = QUERIES["op5_shards"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
