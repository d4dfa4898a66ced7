"""The physical plans: what is shuffled, pruned and pre-aggregated."""

from __future__ import annotations

import re

import pytest
from sample import LEDGER, write_extracts

from quittance.operators.checks import run_checks, values_outside
from quittance.operators.spread import HotKeys
from quittance.plans import marts, publish, quality, staging
from quittance.sources import csv_files


@pytest.fixture
def raw(spark, tmp_path):
    folder = write_extracts(tmp_path / "extracts")
    raw = csv_files.load_raw(spark, folder, str(tmp_path / "raw"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield raw
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


@pytest.fixture
def staged(raw):
    return staging.stage(raw)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles(df):
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|\w+)", _plan(df))


def _keys(df):
    plain = [re.sub(r"#\d+L?|, \d+\)", "", s) for s in _shuffles(df)]
    return [s.replace("hashpartitioning(", "") for s in plain]


def test_ledger_shuffles_without_hot_keys(raw):
    """Each raw table once, and the invoices once more for their customers."""
    staged = staging.stage(raw, HotKeys())
    totals = marts.int_invoice_totals(*(staged[m] for m in quality.STAGING_MODELS))
    assert sorted(_keys(totals)) == ["customer_id", "customer_id", "invoice_id", "invoice_id"]


def test_checks_on_the_ledger_move_the_key_alone(raw):
    """Above the customer join, no counters travel with the invoices."""
    staged = staging.stage(raw, HotKeys())
    totals = marts.int_invoice_totals(*(staged[m] for m in quality.STAGING_MODELS))
    checks = quality.checks_of(quality.declared_checks(), *quality.LEDGER_MODELS)
    plan = _plan(run_checks(totals, checks, clustered=False))
    wide = next(line for line in plan.splitlines() if "Exchange hashpartitioning(tag" in line)
    below = plan[plan.index(wide) :].splitlines()[1]
    assert "partial_count(1)" in below and below.count("count") <= 2
    assert sorted(_keys(run_checks(totals, checks, clustered=False))) == [
        "SinglePartition", "customer_id", "customer_id", "invoice_id", "invoice_id", "tag, key",
    ]


def test_values_of_the_ledger_are_checked_in_one_pass(raw):
    staged = staging.stage(raw, HotKeys())
    totals = marts.int_invoice_totals(*(staged[m] for m in quality.STAGING_MODELS))
    df = values_outside(totals, [("a", "customer_segment", ["x"]), ("b", "invoice_status", ["y"])])
    assert _keys(df).count("customer_id") == 2
    assert "model, column_name, value" in _keys(df)


@pytest.mark.parametrize("hot", [None, HotKeys(parts=((1, 4),)), HotKeys(null_parts=3)])
def test_ledger_shuffles_with_a_hot_invoice(raw, hot):
    """Lines are spread by invoice and line, so their totals are shuffled as well."""
    staged = staging.stage(raw, hot)
    totals = marts.int_invoice_totals(*(staged[m] for m in quality.STAGING_MODELS))
    assert sorted(_keys(totals)) == [
        "customer_id",
        "customer_id",
        "invoice_id",
        "invoice_id",
        "invoice_id, line_item_id",
    ]
    assert "PythonUDF" not in _plan(totals) and "CartesianProduct" not in _plan(totals)
    assert "NestedLoop" not in _plan(totals)


def test_amounts_need_no_customer_shuffle(raw):
    staged = staging.stage(raw, HotKeys())
    invoices, _, lines = (staged[m] for m in quality.STAGING_MODELS)
    amounts = marts.invoice_amounts(invoices, lines)
    assert _keys(quality.breaking(amounts, quality.AMOUNT_HAS_LINES)) == ["invoice_id"] * 2
    # The line totals are not needed here at all.
    assert _keys(quality.breaking(amounts, quality.DUE_AFTER_ISSUE).select("invoice_id")) == [
        "invoice_id"
    ]


def test_line_totals_are_added_up_before_the_shuffle(staged):
    plan = _plan(marts.invoice_line_totals(staged["stg_invoice_line_items"]))
    final, partial = plan.split("Exchange hashpartitioning(invoice_id", 1)
    assert "partial_sum" not in final and "partial_sum" in partial


def test_unused_columns_are_not_read(staged):
    plan = _plan(staged["stg_invoices"])
    assert "ReadSchema: struct<invoice_id:int,customer_id:int" in plan
    lines = marts.line_totals_detail(staged["stg_invoice_line_items"])
    assert "Batched: true" in _plan(lines)


def test_checks_on_computed_staging_add_no_shuffle_by_key(staged):
    checks = quality.checks_of(quality.declared_checks(), "stg_invoices")
    assert _keys(run_checks(staged["stg_invoices"], checks)) == ["SinglePartition", "invoice_id"]


def test_checks_on_a_stored_table_shuffle_the_key_only(spark, staged, tmp_path):
    stored = csv_files.store_table(staged["stg_invoices"], str(tmp_path / "stored"))
    checks = quality.checks_of(quality.declared_checks(), "stg_invoices")
    df = run_checks(stored, checks, stored=True)
    assert sorted(_keys(df)) == ["SinglePartition", "SinglePartition", "invoice_id"]
    assert "ReadSchema: struct<invoice_id:bigint>" in _plan(df)
    assert sorted(map(tuple, df.collect())) == sorted(
        map(tuple, run_checks(stored, checks).collect())
    )


def test_the_ledger_over_stored_staging_moves_invoices_once(raw, wh):
    """What is stored lies by its key, so only the customers' invoices are shuffled."""
    build = wh.new_build("dev")
    publish._store_staging(build, raw, HotKeys())
    build.finish()
    for tables in (build, wh.last_build("dev", *quality.STAGING_MODELS)):
        staged = {m: tables.table(m) for m in quality.STAGING_MODELS}
        totals = marts.int_invoice_totals(*staged.values())
        assert _keys(totals) == ["customer_id"]
        assert len(totals.collect()) == len(LEDGER)
        for model, df in staged.items():
            checks = quality.checks_of(quality.declared_checks(), model)
            found = run_checks(df, checks, stored=True)
            assert set(_keys(found)) == {"SinglePartition"}


def test_lines_of_a_hot_invoice_are_not_put_into_one_bucket(raw, wh):
    build = wh.new_build("dev")
    staged = publish._store_staging(build, raw, HotKeys(parts=((1, 3),), rows=10))
    assert build.layouts.keys() == {"stg_invoices", "stg_customers"}
    assert sorted(_keys(marts.int_invoice_totals(*staged.values()))) == ["customer_id", "invoice_id"]


def test_buckets_divide_the_width_of_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(publish, "shuffle_width", lambda _: 60)
    cores = spark.sparkContext.defaultParallelism
    assert cores == 4
    rows = [1, publish.BUCKET_ROWS * 7, publish.BUCKET_ROWS * 31, 10**13, 0]
    assert [publish._buckets(spark, n) for n in rows] == [4, 10, 60, 60, 60]
