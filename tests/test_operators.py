from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quittance.operators import checks as C
from quittance.operators.dedup import keep_first
from quittance.operators.spread import HotKeys, find_hot_keys, left_join


def _nulls_last(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=_nulls_last)


# -- dedup --------------------------------------------------------------------------------


def test_keep_first_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice([None, *range(20)]), rng.choice([None, 1, 2, 3]), rng.choice([None, 4, 5]))
        for _ in range(500)
    ]
    first = {}
    for row in sorted(rows, key=lambda r: _nulls_last(r[1:])):
        first.setdefault(row[0], row)
    df = spark.createDataFrame(rows, "k int, a int, b int")
    for parts in (1, 6):
        for cluster_by in (None, ["k"]):
            got = keep_first(df.repartition(parts), ["k"], cluster_by)
            assert _rows(got) == sorted(first.values(), key=_nulls_last)


def test_keep_first_prunes_copies_before_the_shuffle(spark):
    # One key holds a third of the rows.
    df = spark.range(0, 90_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    kept = keep_first(df, ["k"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle
    assert kept.count() == 60_001
    assert kept.where("k = -1").first()["v"] == 0


# -- spread join --------------------------------------------------------------------------


@pytest.fixture
def skewed(spark):
    # A third of the rows under key 7, a sixth without a key.
    left = spark.range(0, 60_000, numPartitions=6).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 6 == 1, None)
        .otherwise(F.col("id") % 5_000 + 10)
        .cast("bigint")
        .alias("k"),
    )
    right = spark.range(0, 3_000).select(
        F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name")
    )
    return left, right


def test_hot_keys_are_found_and_bounded(skewed):
    left, _ = skewed
    hot = find_hot_keys(left, "k", width=16)
    assert hot.parts == ((7, 6),)
    assert hot.null_parts == 3
    wide = find_hot_keys(left, "k", width=4000)
    assert len(wide.parts) <= 2000
    assert sum(n for _, n in wide.parts) <= 6000


def test_hot_keys_meet_nowhere(spark, skewed):
    """Neither many partitions nor many keys bring more than a row per key into one task."""
    left, _ = skewed
    assert find_hot_keys(left, "k", width=5_000_000).parts == find_hot_keys(left, "k", 5_000_000).parts
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counted = left.groupBy("k").agg(F.count(F.lit(1)))
        plan = counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SinglePartition" not in plan and "partial_count" in plan


def test_even_keys_need_no_spreading(spark):
    even = spark.range(0, 10_000).select((F.col("id") % 1_000).alias("k"))
    assert not find_hot_keys(even, "k", width=16)
    assert not find_hot_keys(even.where("k < 0"), "k", width=16)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_spread_join_gives_the_plain_join(spark, skewed, broadcast):
    left, right = skewed
    plain = _rows(left.join(right, "k", "left").select("row_id", "k", "name"))
    hot = find_hot_keys(left, "k", width=16)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        for keys in (hot, HotKeys(), HotKeys(parts=((7, 3), (99_999, 2))), HotKeys(null_parts=9)):
            spread = left_join(left, right, "k", "row_id", keys)
            assert _rows(spread.select("row_id", "k", "name")) == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_spread_join_deals_out_the_hot_rows(spark, skewed):
    left, right = skewed
    hot = find_hot_keys(left, "k", width=16)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = left_join(left, right, "k", "row_id", hot)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        plain = left.join(right, "k", "left").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(r["count"] for r in plain) >= 20_000
    assert max(r["count"] for r in sizes) < 14_000


# -- checks -------------------------------------------------------------------------------


@pytest.fixture
def relation(spark):
    rows = [
        (1, "a", 5.0), (1, "a", -1.0), (2, None, None), (None, "z", 0.0),
        (None, "b", 3.0), (3, "z", -2.0), (3, "y", 1.0), (3, "b", 2.0),
    ]
    return spark.createDataFrame(rows, "id int, kind string, amount double")


CHECKS = [
    C.unique("m", "id"),
    *C.not_null("m", "id", "amount"),
    C.accepted_values("m", "kind", ["a", "b"]),
    *C.not_negative("m", "amount"),
    C.assertion("m", "kind_of_first", "id != 1 or kind = 'a'"),
    C.assertion("m", "positive", "amount > 0"),
]


@pytest.mark.parametrize("form", [{}, {"clustered": False}, {"stored": True}])
def test_report_counts_violations(relation, form):
    rows = C.run_checks(relation, CHECKS, **form).collect()
    got = {r["check_id"]: (r["failures"], r["status"]) for r in rows}
    assert got == {
        "unique_m_id": (2, "fail"),
        "not_null_m_id": (2, "fail"),
        "not_null_m_amount": (1, "fail"),
        "accepted_values_m_kind": (3, "fail"),
        "expression_is_true_m_amount": (2, "fail"),
        "kind_of_first": (0, "pass"),
        "positive": (3, "warn"),
    }


@pytest.mark.parametrize("form", [{}, {"clustered": False}, {"stored": True}])
def test_report_on_no_rows_passes(relation, form):
    got = C.run_checks(relation.where("false"), CHECKS, **form).collect()
    assert len(got) == len(CHECKS)
    assert {(r["failures"], r["status"]) for r in got} == {(0, "pass")}


def test_several_unique_columns(relation):
    checks = [C.unique("m", "id"), C.unique("m", "kind"), *C.not_null("m", "kind")]
    got = {r["check_id"]: r["failures"] for r in C.run_checks(relation, checks).collect()}
    assert got == {"unique_m_id": 2, "unique_m_kind": 3, "not_null_m_kind": 1}


@pytest.mark.parametrize("hot_rows", [0, 30])
def test_repeated_keys_are_counted_by_as_many_tasks_as_the_rows_ask_for(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(C, "ROWS_A_TASK", 20)
    rows = [(n, None if n % 7 == 0 else n % 3) for n in range(100)] + [(5, 2), (6, 0), (6, 0), (None, 1)]
    df = spark.createDataFrame(rows + [(8, 2)] * hot_rows, "id bigint, line int")
    hot = find_hot_keys(df, "id", width=16)
    assert bool(hot) == bool(hot_rows) and hot.rows == len(rows) + hot_rows
    got = C.duplicate_keys(df, ["id", "line"], hot)
    expected = [(5, 2, 2), (6, 0, 3), (8, 2, hot_rows + 1)][: 2 + bool(hot_rows)]
    assert _rows(got) == expected == _rows(C.duplicate_keys(df, ["id", "line"]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert f"{-(-hot.rows // 20)}), REPARTITION_BY_NUM" in plan


def test_violators(spark, relation):
    assert _rows(C.duplicate_keys(relation, ["id"])) == [(1, 2), (3, 3)]
    outside = C.values_outside(relation, [("m", "kind", ["a", "b"]), ("n", "kind", ["z"])])
    assert _rows(outside) == [
        ("m", "kind", "y", 1), ("m", "kind", "z", 2),
        ("n", "kind", "a", 2), ("n", "kind", "b", 2), ("n", "kind", "y", 1),
    ]
    parents = spark.createDataFrame([(1,), (2,)], "pk int")
    assert _rows(C.orphans(relation, "id", parents, "pk")) == [(3, 3)]


def test_tally(spark):
    statuses = ["pass", "fail", "fail", "error", "skipped", "warn", "success"]
    report = spark.createDataFrame([(s,) for s in statuses], "status string")
    assert tuple(C.status_tally(report).first()) == (1, 2, 1, 4)
    assert tuple(C.status_tally(report.where("false")).first()) == (0, 0, 0, 0)


def test_declared_checks_are_complete():
    from quittance.plans.quality import declared_checks

    kinds = Counter(c.kind for c in declared_checks())
    assert kinds == {
        "not_null": 29, "expression_is_true": 8, "accepted_values": 5, "unique": 4, "singular": 2,
    }
    ids = [c.check_id for c in declared_checks()]
    assert len(set(ids)) == len(ids)


def test_no_hot_key_is_ever_lost(spark):
    """Keys with more than 2 / width of the rows, however rows are ordered and dealt out."""
    random.seed(13)
    for width, ordered in itertools.product([1, 8, 40], [True, False]):
        heavy = [k for k in range(6) for _ in range(random.choice([0, 5, 400, 1500]))]
        values = heavy + [random.randint(100, 10**6) for _ in range(6000)] + [None] * random.choice([0, 900])
        values.sort(key=str) if ordered else random.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "k bigint").repartition(3)
        found = find_hot_keys(df, "k", width=width)
        counts = Counter(values)
        wanted = {k: -(-n * width // len(values)) for k, n in counts.items() if n * width > 2 * len(values)}
        assert found.null_parts == wanted.pop(None, 0)
        assert dict(found.parts) == wanted
