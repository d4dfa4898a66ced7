from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from edges import TEXTS, documents, no_documents
from pyspark.sql import functions as F

from quittance.llm import simhash
from quittance.llm.components import _with_least, components
from quittance.llm.queries import QUERIES, table

SF_DIR = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(keys, prints, radius=4):
    """The least key reachable from each row over links between fingerprints."""
    found = list(range(len(prints)))

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = sorted((root(i), root(j)))
            found[b] = a
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(root(i), []).append(k)
    return [min((k for k in groups[root(i)] if k is not None), default=None) for i in range(len(prints))]


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_every_pair_within_the_radius_collides(radius):
    masks = [m % (1 << 64) for m in simhash.covering_masks(radius)]
    assert len(masks) == 2 ** (radius + 1) - 1
    assert all(28 <= m.bit_count() <= 44 for m in masks)
    random.seed(1)
    for _ in range(20_000):
        differing = sum(1 << b for b in random.sample(range(64), radius))
        assert any(not differing & m for m in masks)


def test_covering_is_total_for_two_bits():
    masks = [m % (1 << 64) for m in simhash.covering_masks(2)]
    for a, b in itertools.combinations(range(64), 2):
        assert any(not (1 << a | 1 << b) & m for m in masks)


def test_fingerprints():
    random.seed(2)
    texts = ["A b\tC\x1cd e f", "one", "two words", "É É é a b", "\x0b\x0c", *[t for _, t in TEXTS if t is None or len(t) < 500]]
    texts += [" ".join(random.choices(["a", "B", "cc", "dÉ"], k=n)) for n in range(1, 40)]
    for t in texts:
        assert simhash.fingerprint(t, 4, 42) % (1 << 64) == brute_fingerprint(t), t


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("block", [2048, 3])
def test_links_join_what_brute_force_joins(spark, block):
    random.seed(3)
    prints = set()
    for _ in range(12):
        chain = random.getrandbits(64)
        for _ in range(random.randint(1, 9)):
            prints.add(chain)
            for b in random.sample(range(64), random.choice([1, 3, 4, 5])):
                chain ^= 1 << b
    prints |= {0, (1 << 64) - 1, 1}
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    found = simhash.links(df, 4, block)
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 4 for a, b in pairs)
    root = {r["node"]: r["root"] for r in components(found).collect()}
    expected = brute_components([signed(p) for p in prints], prints)
    assert [root.get(signed(p), signed(p)) for p in prints] == expected


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 500), (7, 3)], "a bigint, b bigint")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(201)}
    assert components(chain.where("false")).count() == 0


def test_odd_rows(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    prints = [brute_fingerprint(t) for _, t in TEXTS]
    expected = brute_components([d for d, _ in TEXTS], prints)
    got = sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in rows)
    assert got == sorted((str(d), p, str(c)) for (d, _), p, c in zip(TEXTS, prints, expected, strict=True))
    df = documents(spark)
    kept = simhash.keep_one(df, simhash.near_duplicates(df))
    assert kept.columns == df.columns
    # Two groups may have the same smallest id: rows with one id and unlike texts.
    groups = set(zip(expected, brute_components(prints, prints), strict=True))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(c) for c, _ in groups)
    assert simhash.near_duplicates(no_documents(spark)).count() == 0
    empty = no_documents(spark)
    assert simhash.keep_one(empty, simhash.near_duplicates(empty)).count() == 0


def test_query(spark):
    rows = sorted(table(spark, SF_DIR, "documents").collect())
    got = {r["doc_id"]: r for r in QUERIES["op3_simhash"](spark, SF_DIR).collect()}
    prints = [int(got[r["doc_id"]]["fingerprint"], 16) for r in rows]
    assert prints[:40] == [brute_fingerprint(r["text"]) for r in rows[:40]]
    assert all(len(r["fingerprint"]) == 16 for r in got.values())
    expected = brute_components([r["doc_id"] for r in rows], prints)
    assert [got[r["doc_id"]]["component_id"] for r in rows] == expected
    assert len(set(expected)) < len(rows)


def test_a_forest_links_a_dense_bucket_without_all_pairs():
    members = np.array(sorted({signed(sum(1 << b for b in c)) for c in itertools.combinations(range(12), 2)}))
    assert len(simhash._forest(members, 4)) == len(members) - 1


def test_the_links_of_a_hub_are_dealt_over_tasks(spark):
    """One node with most of the links is no one task's, and the components stay right."""
    hub = [(0, n) for n in range(1, 4000)]
    chain = [(10_000 + n, 10_001 + n) for n in range(60)]
    links = spark.createDataFrame(hub + chain, "b BIGINT, a BIGINT").repartition(4)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = _with_least(both, both.groupBy("a").agg(F.min("b").alias("least")))
        tasks = joined.where("a = 0").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == len(hub)
        assert max(r["count"] for r in tasks) < len(hub) / 2
        root = dict(components(links).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert root == {n: 0 for n in range(4000)} | {10_000 + n: 10_000 for n in range(61)}


def test_rounds_of_few_links_are_stored_in_few_files(spark, monkeypatch):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files, stored = {k: spark.conf.get(k) for k in conf}, [], components.__globals__["stored"]

    def seen(df, purpose):
        files.append(len((kept := stored(df, purpose)).inputFiles()))
        return kept

    monkeypatch.setitem(components.__globals__, "stored", seen)
    monkeypatch.setitem(components.__globals__, "FEW_FILES", 3)
    links = [(n, n + 1) for n in range(60)] + [(500, n) for n in range(501, 700)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        root = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert root == {n: 0 for n in range(61)} | {n: 500 for n in range(500, 700)}
        assert len(files) > 4 and max(files[1:]) <= 3  # the first table holds the links as they came
        files.clear()
        monkeypatch.setitem(components.__globals__, "LINKS_A_FILE", 20)
        components(spark.createDataFrame(links, "a long, b long")).collect()
        assert max(files[1:]) > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fingerprints_and_their_links_are_stored_in_few_files(spark, monkeypatch):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files, stored = {k: spark.conf.get(k) for k in conf}, {}, components.__globals__["stored"]

    def seen(df, purpose):
        files.setdefault(purpose, []).append(len((kept := stored(df, purpose)).inputFiles()))
        return kept

    monkeypatch.setitem(components.__globals__, "stored", seen)
    monkeypatch.setattr(simhash, "stored", seen)
    texts = [f"words of {n // 2} alone that make text {n // 2} what it is" for n in range(300)]
    texts += [f"{t} " + " ".join(f"w{k}" for k in range(400)) for t in texts[:100:2]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == dict(enumerate(brute_components(range(len(texts)), [brute_fingerprint(t) for t in texts])))
    assert max(files["distinct-fingerprints"] + files["links"]) <= components.__globals__["FEW_FILES"] < 40
