from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from sample import CUSTOMERS, INVOICES, LEDGER, LINES, write_extracts

from quittance.operators.contract import BREACH, rejected_rows, valid_rows
from quittance.plans import export, marts, publish, quality, staging
from quittance.queries import LEDGER_V2
from quittance.schemas import CONTRACTS, MART_V1, Contract, raw_schema
from quittance.sources import csv_files, files


@pytest.fixture
def raw(spark, tmp_path):
    folder = write_extracts(tmp_path / "extracts")
    return csv_files.load_raw(spark, folder, str(tmp_path / "raw"))


def _ledger_rows(df):
    return [tuple(r) for r in df.orderBy("invoice_id").collect()]


def _statuses(result):
    return {r["check_id"]: r["status"] for r in result.results}


# -- sources ------------------------------------------------------------------------------


def test_csv_types_blanks_and_quotes(spark, tmp_path):
    folder = write_extracts(tmp_path / "extracts")
    df = csv_files.read_csv(spark, f"{folder}/customers.csv", raw_schema("customers"))
    assert df.schema == raw_schema("customers")
    rows = {r["customer_id"]: r for r in df.collect()}
    assert rows[11]["customer_name"] == " Harbour Bakery "
    assert rows[12]["customer_name"] == "Lumen, Ltd."
    assert rows[12]["email"] is None and rows[14]["segment"] is None


def test_csv_doubled_quotes_and_text_null(spark, tmp_path):
    text = CUSTOMERS + '16,"The ""Old"" Mill",NULL,"",a@b.example\n'
    folder = write_extracts(tmp_path / "extracts", customers=text)
    df = csv_files.read_csv(spark, f"{folder}/customers.csv", raw_schema("customers"))
    row = df.where("customer_id = 16").first()
    assert tuple(row)[1:4] == ('The "Old" Mill', "NULL", None)


@pytest.mark.parametrize(
    "line", ["x,11,1.00,paid,2025-01-01,2025-01-02", "9,11,1.00,paid,soon,2025-01-02", "9,11"]
)
def test_a_row_that_does_not_fit_fails_the_load(spark, tmp_path, line):
    folder = write_extracts(tmp_path / "extracts", invoices=INVOICES + line + "\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        csv_files.load_raw(spark, folder, str(tmp_path / "raw"))


def test_load_is_repeatable_and_counted(spark, tmp_path, raw):
    again = csv_files.load_raw(spark, str(tmp_path / "extracts"), str(tmp_path / "raw"))
    counts = {r["table_name"]: r["row_count"] for r in csv_files.load_manifest(again).collect()}
    assert counts == {"invoices": 9, "customers": 6, "invoice_line_items": 10}
    assert csv_files.read_raw(spark, str(tmp_path / "raw")).keys() == again.keys()


def test_a_bad_extract_leaves_all_raw_tables_as_they_were(spark, tmp_path, raw):
    before = {t: sorted(map(str, df.collect())) for t, df in raw.items()}
    bad = write_extracts(
        tmp_path / "bad", invoices=INVOICES.replace("paid", "sent"), customers=CUSTOMERS + "x,,,,\n"
    )
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        csv_files.load_raw(spark, bad, str(tmp_path / "raw"))
    now = csv_files.read_raw(spark, str(tmp_path / "raw"))
    assert {t: sorted(map(str, df.collect())) for t, df in now.items()} == before
    assert len(list((tmp_path / "raw").iterdir())) == 2  # one load and the pointer


def test_a_table_may_be_replaced_by_what_is_computed_from_it(spark, tmp_path):
    path = str(tmp_path / "t")
    csv_files.refresh_table(spark.range(5), path)
    opened = csv_files.read_table(spark, path)
    csv_files.refresh_table(opened.where("id > 1"), path)
    csv_files.refresh_table(csv_files.read_table(spark, path).where("id > 2"), path)
    assert (opened.count(), csv_files.read_table(spark, path).count()) == (5, 2)
    csv_files.prune(spark, path, keep=1)
    assert csv_files.read_table(spark, path).count() == 2
    assert sum(p.is_dir() for p in (tmp_path / "t").iterdir()) == 1


def test_csv_writer_keeps_outer_spaces(spark, tmp_path):
    rows = spark.createDataFrame([(1, " a ", 'say "x", y', None, "  ")], raw_schema("customers"))
    csv_files.write_csv(rows, str(tmp_path / "csv"))
    back = csv_files.read_csv(spark, str(tmp_path / "csv"), raw_schema("customers"))
    assert back.collect() == rows.collect()


# -- models -------------------------------------------------------------------------------


def test_golden_ledger(raw):
    staged = staging.stage(raw)
    totals = marts.int_invoice_totals(*(staged[m] for m in quality.STAGING_MODELS))
    assert _ledger_rows(totals.select(*MART_V1.read_order)) == [
        tuple(dict(zip(_GOLDEN_COLUMNS, row))[c] for c in MART_V1.read_order) for row in LEDGER
    ]
    assert dict(marts.mart_invoice_ledger(totals).dtypes) == MART_V1.types


_GOLDEN_COLUMNS = [
    "invoice_id",
    "customer_id",
    "customer_name",
    "customer_country",
    "customer_segment",
    "customer_email",
    "invoice_amount",
    "invoice_status",
    "invoice_date",
    "invoice_due_date",
    "payment_terms_days",
    "line_item_count",
    "calculated_invoice_total",
    "amount_discrepancy",
]


def test_staging_types(raw):
    staged = staging.stage(raw)
    assert staged["stg_invoices"].dtypes == [
        ("invoice_id", "bigint"),
        ("customer_id", "bigint"),
        ("invoice_amount", "double"),
        ("invoice_status", "string"),
        ("invoice_date", "date"),
        ("invoice_due_date", "date"),
    ]
    assert staged["stg_invoice_line_items"].dtypes[3:] == [
        ("quantity", "int"),
        ("unit_price", "double"),
    ]


def test_null_keys_collapse_and_are_flagged(spark, raw):
    extra = spark.createDataFrame(
        [(None, 11, "1.00", "paid", None, None), (None, 12, "2.00", "paid", None, None)],
        raw_schema("invoices"),
    )
    staged = staging.stg_invoices(raw["invoices"].unionByName(extra))
    assert staged.where("invoice_id is null").count() == 1
    checks = quality.checks_of(quality.declared_checks(), "stg_invoices")
    report = quality.run_checks(staged, checks)
    found = {r["check_id"]: r["failures"] for r in report.collect()}
    assert found["not_null_stg_invoices_invoice_id"] == 1
    assert found["unique_stg_invoices_invoice_id"] == 0


def test_report_counts_lines_with_and_without_an_invoice(spark, raw):
    extra = spark.createDataFrame(
        [(1, None, "A", -1, "1"), (None, None, "B", 2, "-1"), (8, 1, "C", -2, None)],
        raw_schema("invoice_line_items"),
    )
    raw = {**raw, "invoice_line_items": raw["invoice_line_items"].unionByName(extra)}
    staged = staging.stage(raw)
    amounts = marts.invoice_amounts(staged["stg_invoices"], staged["stg_invoice_line_items"])
    model = "stg_invoice_line_items"
    checks = quality.checks_of(quality.declared_checks(), model)
    expected = {
        f"not_null_{model}_line_item_id": 1,
        f"not_null_{model}_invoice_id": 2,
        f"not_null_{model}_quantity": 0,
        f"not_null_{model}_unit_price": 1,
        f"expression_is_true_{model}_quantity": 2,
        f"expression_is_true_{model}_unit_price": 1,
    }
    unique = quality.unique(model, "line_item_id")
    for wanted, some in ((expected, []), ({**expected, unique.check_id: 1}, [unique])):
        rows = quality.report(staged, amounts, [*checks, *some]).collect()
        assert {r["check_id"]: r["failures"] for r in rows} == wanted
        assert all((r["status"] == "fail") == (r["failures"] > 0) for r in rows)


def test_blank_status_stays_blank(spark):
    row = spark.createDataFrame([(1, 1, "1", "  ", None, None)], raw_schema("invoices"))
    assert staging.stg_invoices(row).first()["invoice_status"] == ""


def test_bad_amount_fails(spark):
    row = spark.createDataFrame([(1, 1, "$5", "paid", None, None)], raw_schema("invoices"))
    with pytest.raises(PySparkException, match="not a number"):
        staging.stg_invoices(row).collect()


def test_advisory_findings(wh, raw):
    publish.build(wh, raw)
    ledger = publish.read_ledger(wh)
    staged = {m: wh.table("prod_blue", m) for m in quality.STAGING_MODELS}

    def ids(expression):
        return sorted(r["invoice_id"] for r in quality.breaking(ledger, expression).collect())

    assert ids(quality.HAS_CUSTOMER) == [4, 7]
    assert ids(quality.AMOUNT_HAS_LINES) == [5, 7, 8]
    assert ids(quality.DUE_AFTER_ISSUE) == [6]
    assert ids(quality.NO_LINES_NO_TOTAL) == []
    assert sorted(tuple(r)[1:] for r in quality.relationships(staged).collect()) == [
        ("stg_customers", 99, 1),
        ("stg_invoices", 77, 1),
    ]
    assert quality.unreconciled(ledger, staged["stg_invoice_line_items"]).count() == 0
    report = publish.recheck(wh, "prod_blue", quality.declared_checks() + quality.ADVISORY_CHECKS)
    warned = {r["check_id"]: r["failures"] for r in report.collect() if r["status"] == "warn"}
    assert warned == {"invoice_has_customer": 2, "amount_has_lines": 3, "due_after_issue": 1}


# -- publish ------------------------------------------------------------------------------


def test_publish_alternates_slots(wh, raw):
    assert publish.deployment_status(wh).first()["active_schema"] == "unknown"
    for read in (publish.read_ledger, publish.register_views):
        with pytest.raises(LookupError):
            read(wh)
    seen = []
    for _ in range(3):
        result = publish.build(wh, raw)
        assert result.published
        seen.append((result.target, publish.deployment_status(wh).first()["active_schema"]))
    assert seen == [("blue", "prod_blue"), ("green", "prod_green"), ("blue", "prod_blue")]
    assert publish.deployments(wh).count() == 3
    assert publish.deployment_state(wh).count() == 1
    ledger = publish.read_ledger(wh)
    assert ledger.columns == list(MART_V1.read_order)
    assert _ledger_rows(ledger) == [
        tuple(dict(zip(_GOLDEN_COLUMNS, row))[c] for c in MART_V1.read_order) for row in LEDGER
    ]


def test_all_results_are_recorded(wh, raw):
    result = publish.build(wh, raw)
    statuses = _statuses(result)
    assert len(statuses) == len(result.results) == 5 + 46 + 2
    assert set(statuses.values()) == {"pass", "success"}
    assert wh.table("prod_blue", "check_results").count() == 53
    assert tuple(publish.status_summary(wh, "prod_blue").first()) == (0, 0, 0, 0)


def test_a_failed_check_skips_what_follows_and_keeps_the_live_slot(spark, wh, raw):
    publish.build(wh, raw)
    before = _ledger_rows(publish.read_ledger(wh))
    bad = dict(raw)
    bad["invoices"] = raw["invoices"].withColumn("status", F.lit("draft"))
    result = publish.build(wh, bad)
    statuses = _statuses(result)
    assert not result.published and result.target == "green"
    assert statuses["accepted_values_stg_invoices_invoice_status"] == "fail"
    assert statuses["mart_invoice_ledger"] == "skipped"
    assert statuses["unique_mart_invoice_ledger_invoice_id"] == "skipped"
    assert publish.deployment_status(wh).first()["active_schema"] == "prod_blue"
    assert _ledger_rows(publish.read_ledger(wh)) == before
    errors, fails, skips, total = publish.status_summary(wh, "prod_green").first()
    assert (errors, fails, total) == (0, 1, 1 + skips) and skips == 2 + 14 + 13 + 2


def test_a_breach_of_an_unchecked_constraint(spark, wh, raw):
    bad = dict(raw)
    bad["invoices"] = raw["invoices"].withColumn(
        "invoice_date", F.when(F.col("invoice_id") != 2, F.col("invoice_date"))
    )
    unseen = ("invoice_date", "payment_terms_days")
    checks = [c for c in quality.declared_checks() if c.column not in unseen]
    result = publish.build(wh, bad, checks=checks)
    statuses = _statuses(result)
    assert statuses["int_invoice_totals"] == "success"
    assert statuses["mart_invoice_ledger"] == "error"
    assert statuses["unique_mart_invoice_ledger_invoice_id"] == "skipped"
    assert not result.published


def test_a_failure_on_the_intermediate_model_skips_the_mart(spark, wh, raw):
    checks = quality.declared_checks() + [
        quality.assertion("int_invoice_totals", "no_gap", "amount_discrepancy = 0", advisory=False)
    ]
    result = publish.build(wh, raw, checks=checks)
    statuses = _statuses(result)
    assert statuses["no_gap"] == "fail"
    assert statuses["mart_invoice_ledger"] == "skipped"
    assert not result.published


def test_a_crash_before_the_pointer_changes_nothing(wh, raw, monkeypatch):
    publish.build(wh, raw)

    def crash(*args, **kwargs):
        raise RuntimeError("lost")

    monkeypatch.setattr(publish, "publish", crash)
    with pytest.raises(RuntimeError, match="lost"):
        publish.build(wh, raw)
    assert publish.deployment_status(wh).first()["active_schema"] == "prod_blue"
    assert publish.read_ledger(wh).count() == len(LEDGER)


def test_dev_builds_without_publishing(wh, raw):
    result = publish.build(wh, raw, target="dev")
    assert not result.published
    assert wh.table("dev", MART_V1.dataset).count() == len(LEDGER)
    assert publish.deployments(wh).count() == 0


def test_the_live_slot_is_never_written(wh, raw):
    publish.build(wh, raw)
    with pytest.raises(ValueError, match="live"):
        publish.build(wh, raw, target="blue")


def test_the_gate_wants_every_expected_check(spark, wh, raw):
    result = publish.build(wh, raw, target="dev")
    rows = spark.createDataFrame(list(result.results), publish.REPORT_DDL)
    expected = quality.declared_checks()

    def gate(df, target="blue"):
        return publish.publish_gate(df, target, expected).first()

    assert gate(rows)["publish"]
    assert not gate(rows, "dev")["publish"]
    assert not gate(rows.where("check_id not like 'unique%'"))["publish"]
    assert gate(rows.where("check_id not like 'unique%'"))["missing_checks"] == 4
    assert not gate(rows.where("false"))["publish"]

    def with_unique(status):
        return rows.withColumn(
            "status", F.when(F.col("kind") == "unique", status).otherwise("pass")
        )

    assert gate(with_unique("warn"))["publish"]
    skipped = with_unique("skipped")
    assert not gate(skipped)["publish"] and gate(skipped)["total_failures"] == 4


def test_min_rows_guards_an_empty_load(spark, tmp_path, wh):
    header = {t: text.splitlines()[0] + "\n" for t, text in
              (("invoices", INVOICES), ("customers", CUSTOMERS), ("invoice_line_items", LINES))}
    folder = write_extracts(tmp_path / "empty", **header)
    empty = csv_files.load_raw(spark, folder, str(tmp_path / "raw-empty"))
    assert not publish.build(wh, empty, min_rows=1).published
    assert publish.build(wh, empty).published
    assert publish.read_ledger(wh).count() == 0
    assert export.export_json(wh, str(tmp_path / "out")).first()["count"] == 0


def test_deployed_at_may_be_given(wh, raw):
    when = datetime(2025, 4, 1, 6, 30)
    publish.build(wh, raw, deployed_at=when)
    assert publish.deployment_state(wh).first()["deployed_at"] == when


def test_rebuild_is_idempotent(wh, raw):
    publish.build(wh, raw)
    first = publish.read_ledger(wh)
    publish.build(wh, raw)
    second = publish.read_ledger(wh)
    n = len(LEDGER)
    assert tuple(publish.idempotence(first, second).first()) == (n, n, 0, 0)
    fewer = second.where("invoice_id <> 1")
    assert tuple(publish.idempotence(first, fewer).first()) == (n, n - 1, 1, 0)
    twice = second.unionByName(second.where("invoice_id = 1"))
    assert tuple(publish.idempotence(first, twice).first()) == (n, n + 1, 0, 1)


def test_builds_are_told_apart_by_their_rows(spark):
    ddl = "a STRING, b STRING, n DOUBLE"

    def prints(*rows):
        return tuple(publish.fingerprint(spark.createDataFrame(rows, ddl)).first())

    some = [("x", None, 1.0), (None, "x", 1.0), ("x", None, 1.0)]
    assert prints(*some) == prints(*reversed(some))
    assert prints(*some[:2]) != prints(*some)
    assert prints(some[0]) != prints(some[1])
    assert prints(some[0], some[0], some[1]) != prints(some[0], some[1], some[1])
    assert prints(("", "x", 1.0)) != prints((None, "x", 1.0)) != prints(("x", "", 1.0))
    assert set(prints()) == {0}


def test_equal_builds_are_compared_without_moving_rows(wh, raw, monkeypatch):
    publish.build(wh, raw)
    first = publish.read_ledger(wh)

    def never(*_):
        raise AssertionError("the rows agree")

    monkeypatch.setattr(publish, "row_differences", never)
    publish.build(wh, raw)
    second = publish.read_ledger(wh)
    assert publish.idempotence(first, second).first()["only_first"] == 0
    empty = first.where("false")
    assert tuple(publish.idempotence(empty, empty).first()) == (0, 0, 0, 0)
    with pytest.raises(AssertionError, match="agree"):
        publish.idempotence(first, empty)


def test_a_broken_sum_is_found_by_the_reconciliation(raw, monkeypatch):
    """The check adds amounts up by a way of its own."""
    staged = staging.stage(raw)
    tables = [staged[m] for m in quality.STAGING_MODELS]
    good = marts.int_invoice_totals(*tables)
    assert quality.unreconciled(good, tables[2]).count() == 0
    monkeypatch.setattr(marts, "exact_sum", lambda price, times: F.sum(price))
    broken = marts.int_invoice_totals(*tables)
    assert {r["invoice_id"] for r in quality.unreconciled(broken, tables[2]).collect()} >= {1, 2, 3}


def test_large_and_odd_amounts_reconcile(spark):
    ddl = "line_item_id BIGINT, invoice_id BIGINT, product_name STRING, quantity INT, unit_price DOUBLE"
    amounts = {
        1: [(2, 1e25), (3, 1.5)],
        2: [(2_000_000_000, 9e8)] * 100,
        3: [(1, 1e-9)] * 1000 + [(None, 4.0), (4, None)],
        4: [(2, 0.1), (1, 123456789.123456)],
        5: [(None, 1.0)],
    }
    rows = [(n, i, "", q, p) for i, all_ in amounts.items() for n, (q, p) in enumerate(all_)]
    lines = spark.createDataFrame(rows, ddl)
    ledger = marts.invoice_line_totals(lines).withColumn(
        "calculated_invoice_total", F.coalesce("calculated_invoice_total", F.lit(0.0))
    )
    assert quality.unreconciled(ledger, lines).collect() == []
    off = ledger.withColumn("calculated_invoice_total", F.expr("calculated_invoice_total * (1 + 1e-9) + 1e-5"))
    assert quality.unreconciled(off, lines).count() == 5
    bad = lines.withColumn("unit_price", F.lit(float("nan")))
    found = {r["invoice_id"] for r in quality.unreconciled(ledger, bad).collect()}
    assert found == {1, 2, 3, 4}  # without a quantity there is no amount, whatever the price


def test_views_and_reset(spark, wh, raw, tmp_path):
    publish.build(wh, raw)
    publish.register_views(wh)
    assert spark.table("public.mart_invoice_ledger").count() == len(LEDGER)
    assert spark.table("public.deployment_state").first()["active_schema"] == "prod_blue"
    publish.register_slot(wh, "prod_blue")
    matched = spark.sql(
        "SELECT count(*) FROM prod_blue.int_invoice_totals t "
        "JOIN prod_blue.stg_invoices i ON t.invoice_id = i.invoice_id "
        "JOIN prod_blue.mart_invoice_ledger_v1 m ON m.invoice_id = i.invoice_id"
    )
    assert matched.first()[0] == len(LEDGER)
    assert spark.table("prod_blue.stg_invoice_line_items").count() == 8
    other = publish.Warehouse(spark, str(tmp_path / "other"))
    publish.reset(other)
    assert spark.table("public.mart_invoice_ledger").count() == len(LEDGER)
    spark.sql("CREATE TABLE public.not_ours USING parquet AS SELECT 1 AS x")
    publish.reset(wh)
    assert publish.deployment_status(wh).first()["active_schema"] == "unknown"
    assert not (tmp_path / "warehouse" / "prod_blue").exists()
    assert not spark.catalog.tableExists("public.mart_invoice_ledger")
    assert spark.table("public.not_ours").count() == 1
    spark.sql("DROP TABLE public.not_ours")


def test_refused_rows_never_show(spark, wh, raw):
    """The view moves with every publish and never to a build that the gate refused."""
    publish.build(wh, raw)
    publish.register_views(wh)
    bad = {**raw, "customers": raw["customers"].withColumn("customer_name", F.lit("not this"))}
    checks = quality.declared_checks() + [
        quality.assertion("mart_invoice_ledger", "named", "customer_name <> 'not this'", advisory=False)
    ]
    publish.build(wh, raw)
    assert not publish.build(wh, bad, checks=checks).published
    seen = spark.table("public.mart_invoice_ledger")
    assert _ledger_rows(seen) == _ledger_rows(publish.read_ledger(wh))
    assert seen.where("customer_name = 'not this'").count() == 0
    assert spark.table("public.deployment_state").first()["active_schema"] == "prod_green"
    fewer = {**raw, "invoices": raw["invoices"].where("invoice_id > 2")}
    assert publish.build(wh, fewer).published
    assert spark.table("public.mart_invoice_ledger").count() == len(LEDGER) - 2
    publish.reset(wh)


def test_a_reader_keeps_its_rows_through_later_deployments(wh, raw):
    publish.build(wh, raw)
    opened = publish.read_ledger(wh)
    for keep in (1, 2, 3):
        publish.build(wh, {**raw, "invoices": raw["invoices"].where(f"invoice_id > {keep}")})
    assert _ledger_rows(opened) == [
        tuple(dict(zip(_GOLDEN_COLUMNS, row))[c] for c in MART_V1.read_order) for row in LEDGER
    ]
    publish.prune(wh, keep=1)
    assert publish.read_ledger(wh).count() == len(LEDGER) - 3
    assert [len(wh.builds(s)) for s in ("prod_blue", "prod_green")] == [1, 1]


def test_the_last_publish_is_live_whatever_the_clocks_say(wh, raw):
    for year in (2030, 2020, 2025):
        result = publish.build(wh, raw, deployed_at=datetime(year, 1, 1))
        assert result.published
        live = publish.live_build(wh)
        assert live.schema == publish.TARGETS[result.target]
        assert publish.deployment_state(wh).first()["deployed_at"].year == year


def test_publishes_at_once_get_numbers_of_their_own(wh, raw):
    builds = []
    for _ in range(4):
        build = wh.new_build("prod_blue")
        build.store(wh.spark.range(1).toDF("invoice_id"), MART_V1.dataset)
        builds.append(build)
    assert len({b.name for b in builds}) == 4
    with ThreadPoolExecutor(4) as jobs:
        list(jobs.map(publish.publish, builds))
    assert publish.live_build(wh) in builds
    numbers = [r["deployment_no"] for r in publish.deployments(wh).collect()]
    assert sorted(numbers) == [1, 2, 3, 4]


def test_an_unreadable_state_is_unknown(wh, raw, tmp_path):
    publish.build(wh, raw)
    for part in (tmp_path / "warehouse" / "public" / "deployments" / "log").glob("*.json"):
        part.write_bytes(b"damaged")
    assert tuple(publish.deployment_status(wh).first()) == ("healthy", "unknown", None)


def test_a_view_stays_with_its_warehouse(spark, wh, raw, tmp_path):
    other = publish.Warehouse(spark, str(tmp_path / "other"))
    publish.build(wh, raw)
    publish.register_views(wh)
    publish.build(other, {**raw, "invoices": raw["invoices"].where("invoice_id > 2")})
    with pytest.raises(publish.ForeignView, match="warehouse"):
        publish.register_views(other)
    publish.build(other, raw)
    publish.build(wh, {**raw, "invoices": raw["invoices"].where("invoice_id > 3")})
    assert spark.table("public.mart_invoice_ledger").count() == len(LEDGER) - 3
    own = publish.Warehouse(spark, other.root, public="elsewhere")
    publish.register_views(own)
    assert spark.table("elsewhere.mart_invoice_ledger").count() == len(LEDGER)
    publish.reset(own)
    publish.reset(wh)
    spark.sql("CREATE OR REPLACE VIEW public.mart_invoice_ledger AS SELECT 1 AS x")
    publish.build(wh, raw)
    with pytest.raises(publish.ForeignView, match="somebody else"):
        publish.register_views(wh)
    spark.sql("DROP VIEW public.mart_invoice_ledger")


def test_the_name_of_a_warehouse_that_is_gone_is_free(spark, wh, raw, tmp_path):
    other = publish.Warehouse(spark, str(tmp_path / "other"))
    publish.build(other, raw)
    publish.register_views(other)
    files.delete(spark, other.root)
    publish.build(wh, raw)
    publish.register_views(wh)
    assert spark.table("public.mart_invoice_ledger").count() == len(LEDGER)
    publish.reset(wh)


#: What a publish does, step by step, after the build has been audited.
STEPS = [
    (publish.Build, "finish"),
    (publish.DeploymentLog, "append"),
    (files, "put_once"),
    (files, "replace_text"),
    (publish, "move_views"),
    (publish, "_create_view"),
]


@pytest.mark.parametrize("before", [True, False])
@pytest.mark.parametrize("owner,step", STEPS, ids=[s for _, s in STEPS])
def test_a_driver_killed_at_any_step_leaves_the_old_or_the_new(spark, wh, raw, monkeypatch, owner, step, before):
    publish.build(wh, raw)
    publish.register_views(wh)
    made = wh.new_build("prod_green")
    for table in (*publish.STAGING_MODELS, MART_V1.dataset):
        made.store(wh.table("prod_blue", table).limit(3), table)
    real = getattr(owner, step)

    def killed(*args, **kwargs):
        if not before:
            real(*args, **kwargs)
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(owner, step, killed)
        with pytest.raises(KeyboardInterrupt):
            publish.publish(made)
    live = publish.live_build(wh)
    count = {"prod_blue": len(LEDGER), "prod_green": 3}
    assert publish.read_ledger(wh).count() == count[live.schema]
    assert spark.table("public.mart_invoice_ledger").count() in count.values()
    assert publish.recheck(wh, "prod_blue").count() == 48
    assert publish.build(wh, raw).published  # and the next deployment goes on from there
    assert spark.table("public.mart_invoice_ledger").count() == len(LEDGER)
    numbers = sorted(r["deployment_no"] for r in publish.deployments(wh).collect())
    assert numbers == list(range(1, len(numbers) + 1))
    publish.reset(wh)


def test_a_killed_build_is_not_the_newest(wh, raw, monkeypatch):
    publish.build(wh, raw)
    publish.build(wh, raw)

    def killed(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(publish, "_build_ledger", killed)
        with pytest.raises(KeyboardInterrupt):
            publish.build(wh, raw)
    assert len(wh.builds("prod_blue")) == 2
    assert wh.last_build("prod_blue").name == wh.builds("prod_blue")[0]
    assert {r["status"] for r in publish.recheck(wh, "prod_blue").collect()} == {"pass"}
    held = wh.last_build("prod_blue").catalogue()
    assert held.keys() == {*publish.STAGING_MODELS, MART_V1.dataset, "check_results"}
    assert all(t["files"] > 0 and t["bytes"] > 0 for t in held.values())
    publish.prune(wh, keep=1)
    assert len(wh.builds("prod_blue")) == 2  # it might still be running
    publish.prune(wh, keep=1, lease=0)
    assert len(wh.builds("prod_blue")) == 1


# -- hand-over ----------------------------------------------------------------------------


def test_export(wh, raw, tmp_path):
    publish.build(wh, raw)
    out = str(tmp_path / "out")
    manifest = export.export_json(wh, out, ordered=True).first()
    assert (manifest["count"], manifest["version"]) == (len(LEDGER), "v1")
    lines = [
        json.loads(line)
        for part in sorted(Path(export.rows_folder(wh.spark, out)).glob("part-*"))
        for line in part.read_text(encoding="utf-8").splitlines()
    ]
    assert [r["invoice_id"] for r in lines] == list(range(1, 9))
    assert all(set(r) == set(MART_V1.read_order) for r in lines)
    assert lines[6]["customer_name"] is None
    assert _ledger_rows(export.read_export(wh, out)) == _ledger_rows(publish.read_ledger(wh))


def test_one_bad_row_fails_the_export(wh, raw, tmp_path):
    publish.build(wh, raw)
    out = str(tmp_path / "out")
    export.export_json(wh, out)
    before = _ledger_rows(export.read_export(wh, out))
    bad = wh.table("prod_blue", MART_V1.dataset).withColumn("invoice_status", F.lit("deleted"))
    _publish_as_is(wh, bad)
    with pytest.raises(PySparkException, match=BREACH):
        export.export_json(wh, out)
    assert _ledger_rows(export.read_export(wh, out)) == before
    assert export.read_manifest(wh.spark, out).first()["count"] == len(LEDGER)
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == 1
    publish.build(wh, raw)
    export.export_json(wh, out)
    export.prune_exports(wh.spark, out)
    assert _ledger_rows(export.read_export(wh, out)) == before


def _publish_as_is(wh, ledger):
    build = wh.new_build("prod_green")
    build.store(ledger, MART_V1.dataset)
    publish.publish(build)


def test_columns_outside_the_contract_do_not_leak(wh, raw):
    publish.build(wh, raw)
    _publish_as_is(wh, wh.table("prod_blue", MART_V1.dataset).withColumn("secret", F.lit(1)))
    assert publish.read_ledger(wh).columns == list(MART_V1.read_order)


def test_an_old_version_stays_readable_beside_a_new_one(wh, raw, monkeypatch):
    v2 = Contract(
        version="v2",
        dataset="mart_invoice_ledger_v2",
        columns=tuple(c for c in MART_V1.columns if c.name != "customer_email"),
        read_order=tuple(c for c in MART_V1.read_order if c != "customer_email"),
    )
    monkeypatch.setitem(CONTRACTS, "v2", v2)
    assert publish.build(wh, raw).published
    assert publish.read_ledger(wh, "v1").columns == list(MART_V1.read_order)
    assert publish.read_ledger(wh, "v2").columns == list(v2.read_order)
    assert publish.read_ledger(wh, "v2").count() == len(LEDGER)


def test_a_version_may_rename_and_derive_and_has_rules_of_its_own(spark, raw, tmp_path):
    wh = publish.Warehouse(spark, str(tmp_path / "two"), {"v1": MART_V1, "v2": LEDGER_V2})
    assert publish.build(wh, raw).published
    second = publish.read_ledger(wh, "v2")
    assert second.columns == list(LEDGER_V2.read_order)
    row = second.where("invoice_id = 2").first()
    assert (row["billed_amount"], row["customer_label"], row["is_overdue"]) == (
        100.0, "Lumen, Ltd. / IE", True,
    )
    publish.register_views(wh, "v2")
    assert spark.table("public.mart_invoice_ledger_v2").columns == list(LEDGER_V2.read_order)
    odd = second.withColumn("billed_amount", F.lit(-1.0))
    assert valid_rows(odd, LEDGER_V2).count() == 0
    assert rejected_rows(odd, LEDGER_V2).first()["violations"] == "billed_amount:negative"
    assert export.export_json(wh, str(tmp_path / "out2"), "v2").first()["version"] == "v2"
    publish.reset(wh)


def test_display(wh, raw):
    publish.build(wh, raw)
    shown = export.ledger_display(publish.read_ledger(wh)).where("invoice_id = 6").first()
    assert shown["amount_discrepancy"] == "-$20.00"
    assert shown["invoice_date"] == "Mar 6, 2025"
    assert shown["invoice_status"] == "Paid"
    orphan = export.ledger_display(publish.read_ledger(wh)).where("invoice_id = 7").first()
    assert orphan["customer_name"] == "—"
