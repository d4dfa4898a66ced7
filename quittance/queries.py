"""The registered queries: each reads the benchmark tables under a folder and returns a result."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, time, timedelta
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.functions.text import blank_to_null, lower, or_unknown, strip, upper
from quittance.operators.checks import duplicate_keys, run_checks, status_tally, values_outside
from quittance.operators.contract import (
    constraint_report,
    rejected_rows,
    schema_report,
    valid_rows,
)
from quittance.operators.spread import HotKeys, find_hot_keys
from quittance.plans import export, marts, publish, quality, staging
from quittance.schemas import (
    CUSTOMER_SEGMENTS,
    INVOICE_STATUSES,
    MART_V1,
    RAW_KEYS,
    Column,
    Contract,
    raw_schema,
)
from quittance.session import work_folder
from quittance.sources import csv_files, testbed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _hot_invoices(spark: SparkSession, sf_dir: str) -> HotKeys:
    return find_hot_keys(testbed.line_owners(spark, sf_dir), "invoice_id")


def _hot_customers(spark: SparkSession, sf_dir: str) -> HotKeys:
    return find_hot_keys(testbed.invoice_owners(spark, sf_dir), "customer_id")


def _staged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return staging.stage(testbed.read_sources(spark, sf_dir), _hot_invoices(spark, sf_dir))


def _models(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The staging tables and the ledger over them."""
    staged = _staged(spark, sf_dir)
    tables = [staged[m] for m in quality.STAGING_MODELS]
    return staged, marts.int_invoice_totals(*tables, _hot_customers(spark, sf_dir))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir)[1]


def _checks() -> list:
    return quality.declared_checks(testbed.SEGMENTS)


def _warehouse(spark: SparkSession, **settings) -> publish.Warehouse:
    return publish.Warehouse(spark, work_folder(spark, "warehouse"), **settings)


def _deploy(
    wh: publish.Warehouse,
    sf_dir: str,
    raw: dict[str, DataFrame] | None = None,
    deployed_at: datetime | None = None,
) -> publish.BuildResult:
    return publish.build(
        wh,
        raw or testbed.read_sources(wh.spark, sf_dir),
        checks=_checks(),
        deployed_at=deployed_at,
        hot_invoices=_hot_invoices(wh.spark, sf_dir),
    )


def _midnight_after_last_invoice(spark: SparkSession, sf_dir: str, days: int) -> datetime:
    invoices = testbed.read_source(spark, sf_dir, "invoices")
    last = invoices.agg(F.max("invoice_date")).first()[0]
    return datetime.combine(last, time()) + timedelta(days=days)


# -- sources and sinks --------------------------------------------------------------------


def _csv_round_trip(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    folder = work_folder(spark, "csv")
    csv_files.write_csv(testbed.read_source(spark, sf_dir, table), folder)
    return csv_files.read_csv(spark, folder, raw_schema(table, wide_ids=True))


@_query
def raw_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_round_trip(spark, sf_dir, "invoices")


@_query
def raw_csv_scan_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_round_trip(spark, sf_dir, "customers")


@_query
def raw_csv_scan_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _csv_round_trip(spark, sf_dir, "invoice_line_items")


@_query
def raw_csv_scan_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose product names hold line breaks and quotes, from files that many tasks read."""
    folder = work_folder(spark, "csv")
    lines = testbed.wrapped(testbed.read_source(spark, sf_dir, "invoice_line_items"))
    csv_files.write_csv(lines, folder)
    schema = raw_schema("invoice_line_items", wide_ids=True)
    return csv_files.read_csv(spark, folder, schema, line_breaks=True)


@_query
def raw_refresh_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "raw")
    customers = testbed.read_source(spark, sf_dir, "customers")
    csv_files.refresh_table(customers, folder)
    return csv_files.refresh_table(customers, folder)


@_query
def load_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_files.load_manifest(testbed.read_sources(spark, sf_dir))


# -- models -------------------------------------------------------------------------------


@_query
def stg_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_invoices(testbed.read_source(spark, sf_dir, "invoices"))


@_query
def stg_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_customers(testbed.read_source(spark, sf_dir, "customers"))


@_query
def stg_invoice_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_invoice_line_items(
        testbed.read_source(spark, sf_dir, "invoice_line_items"), _hot_invoices(spark, sf_dir)
    )


@_query
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded, letters = F.col("padded"), F.col("letters")
    return testbed.messy_text(spark, sf_dir).select(
        "customer_id",
        blank_to_null(strip(padded)).alias("name"),
        blank_to_null(strip(upper(letters))).alias("country"),
        or_unknown(lower(strip(letters))).alias("segment"),
        blank_to_null(lower(strip(padded))).alias("email"),
        or_unknown(strip(lower(padded))).alias("status"),
    )


@_query
def line_totals_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.line_totals_detail(stg_invoice_line_items(spark, sf_dir))


@_query
def invoice_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.invoice_line_totals(stg_invoice_line_items(spark, sf_dir))


@_query
def invoice_line_totals_small_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of lines that are worth less than a millionth each."""
    lines = testbed.metered(testbed.read_source(spark, sf_dir, "invoice_line_items"))
    return marts.invoice_line_totals(staging.stg_invoice_line_items(lines))


@_query
def ledger_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger where one customer, one invoice and one line hold a third of the rows each."""
    raw = testbed.skewed(testbed.read_sources(spark, sf_dir))
    hot_lines = find_hot_keys(raw["invoice_line_items"], "invoice_id")
    staged = staging.stage(raw, hot_lines)
    hot_customers = find_hot_keys(raw["invoices"], "customer_id")
    return marts.int_invoice_totals(*(staged[m] for m in quality.STAGING_MODELS), hot_customers)


@_query
def invoice_customer_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.invoice_customer_enrich(
        stg_invoices(spark, sf_dir), stg_customers(spark, sf_dir), _hot_customers(spark, sf_dir)
    )


@_query
def int_invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)


@_query
def mart_invoice_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.mart_invoice_ledger(_ledger(spark, sf_dir))


# -- checks -------------------------------------------------------------------------------


@_query
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys of the raw tables, which the staging and ledger keys must not have."""
    raw = testbed.read_sources(spark, sf_dir)
    owners = raw | {"invoice_line_items": testbed.line_owners(spark, sf_dir)}
    hot = {t: find_hot_keys(owners[t], RAW_KEYS[t][0]) for t in raw}
    staged = staging.stage(raw, hot["invoice_line_items"])
    tables = [staged[m] for m in quality.STAGING_MODELS]
    ledger = marts.int_invoice_totals(*tables, _hot_customers(spark, sf_dir))
    relations = [(f"raw.{t}", raw[t], RAW_KEYS[t], hot[t]) for t in raw]
    even = HotKeys(rows=hot["invoices"].rows)
    relations += [  # the staging tables lie by their keys already
        ("stg_invoices", staged["stg_invoices"], ["invoice_id"], None),
        ("stg_customers", staged["stg_customers"], ["customer_id"], None),
        ("mart_invoice_ledger", ledger, ["invoice_id"], even),
    ]
    found = [
        duplicate_keys(df, keys, hot_keys).select(
            F.lit(model).alias("model"),
            F.lit(",".join(keys)).alias("column_name"),
            F.concat_ws(",", *keys).alias("key_value"),
            "n_records",
        )
        for model, df, keys, hot_keys in relations
    ]
    return reduce(DataFrame.unionAll, found)


def _built(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The staging tables and the mart as a build stores them."""
    staged, ledger = _models(spark, sf_dir)
    folder = work_folder(spark, "build")
    mart = csv_files.store_table(marts.mart_invoice_ledger(ledger), f"{folder}/mart")
    return staged, mart


def _row_wise(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Failures per declared check of one kind, on the models, the mart and spoilt mart rows."""
    checks = [c for c in _checks() if c.kind == kind]
    staged, mart = _built(spark, sf_dir)
    on_mart = quality.checks_of(checks, "mart_invoice_ledger")
    spoilt = run_checks(testbed.spoil_ledger(mart), on_mart).withColumn(
        "model", F.lit("spoilt_ledger")
    )
    return (
        quality.report(staged, mart, checks)
        .unionAll(spoilt)
        .select("model", "column_name", "failures", "status")
    )


@_query
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_wise(spark, sf_dir, "not_null")


@_query
def dq_expression_is_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _row_wise(spark, sf_dir, "expression_is_true")


@_query
def dq_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside the default lists; the benchmark customers have segments of their own."""
    staged, ledger = _models(spark, sf_dir)
    invoices, customers, _ = quality.STAGING_MODELS
    totals, mart = quality.LEDGER_MODELS
    status, segment = ("invoice_status", INVOICE_STATUSES), ("customer_segment", CUSTOMER_SEGMENTS)
    found = [
        values_outside(staged[invoices], [(invoices, *status)]),
        values_outside(staged[customers], [(customers, *segment)]),
        values_outside(ledger, [(totals, *segment), (totals, *status), (mart, *status)]),
    ]
    return reduce(DataFrame.unionAll, found)


@_query
def dq_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.relationships(_staged(spark, sf_dir))


@_query
def dq_invoice_without_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.breaking(_ledger(spark, sf_dir), quality.HAS_CUSTOMER).select(
        "invoice_id", "customer_name"
    )


@_query
def dq_amount_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.breaking(_ledger(spark, sf_dir), quality.AMOUNT_HAS_LINES).select(
        "invoice_id", "line_item_count", "invoice_amount"
    )


@_query
def dq_line_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoilt = testbed.spoil_lines(line_totals_detail(spark, sf_dir))
    return quality.wrong_line_totals(spoilt).select("line_item_id", "invoice_id", "line_total")


@_query
def dq_total_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged, ledger = _models(spark, sf_dir)
    return quality.unreconciled(
        testbed.spoil_ledger(ledger), staged["stg_invoice_line_items"]
    )


@_query
def dq_zero_line_zero_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoilt = testbed.spoil_ledger(_ledger(spark, sf_dir))
    return quality.breaking(spoilt, quality.NO_LINES_NO_TOTAL).select(
        "invoice_id", "line_item_count", "calculated_invoice_total"
    )


@_query
def dq_date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.breaking(_ledger(spark, sf_dir), quality.DUE_AFTER_ISSUE).select(
        "invoice_id", "invoice_date", "invoice_due_date"
    )


@_query
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(*_models(spark, sf_dir), _checks() + quality.ADVISORY_CHECKS)


@_query
def dq_status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tally of the default checks, whose segment lists the benchmark customers do not meet."""
    checks = quality.declared_checks() + quality.ADVISORY_CHECKS
    return status_tally(quality.report(*_models(spark, sf_dir), checks))


# -- contract -----------------------------------------------------------------------------


@_query
def contract_schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_report(mart_invoice_ledger(spark, sf_dir), MART_V1)


@_query
def contract_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraint_report(testbed.spoil_ledger(mart_invoice_ledger(spark, sf_dir)), MART_V1)


@_query
def contract_rows_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(testbed.spoil_ledger(_ledger(spark, sf_dir)))


@_query
def contract_rows_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_rows(testbed.spoil_ledger(_ledger(spark, sf_dir))).select(
        "invoice_id", "violations"
    )


# -- publish ------------------------------------------------------------------------------


def _publish_as_is(wh: publish.Warehouse, ledger: DataFrame) -> None:
    """Make a ledger live without asking the gate."""
    build = wh.new_build("prod_blue")
    build.store(ledger, MART_V1.dataset)
    publish.publish(build)


@_query
def publish_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = _warehouse(spark)
    _deploy(wh, sf_dir)
    return publish.read_ledger(wh)


@_query
def ledger_read_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live ledger after the stored table has gained a column that is not contracted."""
    wh = _warehouse(spark)
    ledger = marts.mart_invoice_ledger(_ledger(spark, sf_dir))
    wider = ledger.withColumn("internal_note", F.concat(F.lit("row "), "invoice_id"))
    _publish_as_is(wh, wider)
    return publish.read_ledger(wh, "v1")


@_query
def failed_publish_keeps_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = _warehouse(spark)
    _deploy(wh, sf_dir)
    raw = testbed.read_sources(spark, sf_dir)
    raw["invoices"] = testbed.spoil_invoices(raw["invoices"])
    _deploy(wh, sf_dir, raw)
    return publish.read_ledger(wh)


@_query
def public_view_after_failed_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL users see after two deployments and a build that the gate refused."""
    wh = replace(_warehouse(spark), public=f"public_{uuid.uuid4().hex}")
    _deploy(wh, sf_dir)
    publish.register_views(wh)
    _deploy(wh, sf_dir)
    raw = testbed.read_sources(spark, sf_dir)
    raw["customers"] = raw["customers"].withColumn("customer_name", F.lit("not this"))
    raw["invoices"] = raw["invoices"].withColumn("status", F.lit("not this"))
    _deploy(wh, sf_dir, raw)
    return spark.table(f"{wh.public}.mart_invoice_ledger")


@_query
def view_of_two_warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A public view stays with its warehouse, though another one deploys and asks for the name."""
    first = replace(_warehouse(spark), public=f"public_{uuid.uuid4().hex}")
    second = replace(_warehouse(spark), public=first.public)
    _deploy(first, sf_dir)
    publish.register_views(first)
    raw = testbed.read_sources(spark, sf_dir)
    _deploy(second, sf_dir, raw | {"invoices": raw["invoices"].where("invoice_id % 2 = 0")})
    try:
        publish.register_views(second)
    except publish.ForeignView:
        return spark.table(f"{first.public}.mart_invoice_ledger")
    raise AssertionError("a view was taken from another warehouse")


@_query
def reset_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warehouse after a reset and a deployment: both start anew, with slot blue."""
    wh = replace(_warehouse(spark), public=f"public_{uuid.uuid4().hex}")
    for _ in range(2):
        _deploy(wh, sf_dir)
    publish.register_views(wh)
    publish.reset(wh)
    if publish.deployments(wh).count() or spark.catalog.tableExists(f"{wh.public}.mart_invoice_ledger"):
        raise AssertionError("a reset left something behind")
    _deploy(wh, sf_dir)
    slot = publish.deployment_status(wh).first()["active_schema"]
    return publish.read_ledger(wh).withColumn("active_schema", F.lit(slot))


@_query
def recheck_stored_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks over a slot as it lies there, nothing being built."""
    wh = _warehouse(spark)
    _deploy(wh, sf_dir)
    return publish.recheck(wh, "prod_blue", _checks() + quality.ADVISORY_CHECKS)


#: A second version: the amount has another name, the customer is one text, the gap is a share.
LEDGER_V2 = Contract(
    version="v2",
    dataset="mart_invoice_ledger_v2",
    columns=(
        Column("invoice_id", "bigint", required=True),
        Column(
            "billed_amount", "double", required=True, check="billed_amount >= 0", source="invoice_amount"
        ),
        Column(
            "customer_label",
            "string",
            source="concat_ws(' / ', coalesce(customer_name, '?'), coalesce(customer_country, '?'))",
        ),
        Column("is_overdue", "boolean", required=True, source="invoice_status = 'overdue'"),
        Column("line_item_count", "bigint", required=True),
    ),
    read_order=("invoice_id", "customer_label", "billed_amount", "is_overdue", "line_item_count"),
    row_required=("invoice_id", "billed_amount", "is_overdue"),
    row_not_negative=("billed_amount", "line_item_count"),
)


@_query
def ledger_two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of one build, read side by side, each by its own contract."""
    wh = _warehouse(spark, contracts={"v1": MART_V1, "v2": LEDGER_V2})
    _deploy(wh, sf_dir)
    first, second = publish.read_ledger(wh, "v1"), publish.read_ledger(wh, "v2")
    return valid_rows(first).join(valid_rows(second, LEDGER_V2), ["invoice_id", "line_item_count"])


@_query
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate for every target, on passing checks and on the default segment lists.

    One report holds both: the checks that differ are there a second time under another name.
    """
    own, default = _checks(), quality.declared_checks()
    differing = [c for c, d in zip(own, default) if c != d]
    renamed = [replace(d, name=f"default_{d.check_id}") for d in default if d not in own]
    results = csv_files.store_table(
        quality.report(*_models(spark, sf_dir), own + renamed),
        work_folder(spark, "report"),
    )
    with_own = results.where(~F.col("check_id").isin([c.check_id for c in renamed]))
    with_default = results.where(~F.col("check_id").isin([c.check_id for c in differing]))
    with_default = with_default.withColumn(
        "check_id", F.regexp_replace("check_id", "^default_", "")
    )
    rows = [
        publish.publish_gate(found, target, own).select(F.lit(name).alias("segments"), "*")
        for name, found in (("own lists", with_own), ("default lists", with_default))
        for target in publish.TARGETS
    ]
    return reduce(DataFrame.unionAll, rows)


@_query
def next_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot to build before the first deployment, after it and after the second."""
    wh = _warehouse(spark)
    first = publish.next_slot(publish.latest_deployment(wh)).withColumn("deployed", F.lit(0))
    rows = [first]
    for n in (1, 2):
        _deploy(wh, sf_dir)
        state = publish.deployments(wh).where(F.col("deployment_no") == n)
        rows.append(publish.next_slot(state).withColumn("deployed", F.lit(n)))
    return reduce(DataFrame.unionAll, rows)


@_query
def latest_deployment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last deployment, though a clock that runs behind dated it before the first."""
    wh = _warehouse(spark)
    for days in (0, -1):
        _deploy(wh, sf_dir, deployed_at=_midnight_after_last_invoice(spark, sf_dir, days))
    return publish.latest_deployment(wh).select(
        "active_schema", F.col("deployed_at").cast("timestamp_ntz").alias("deployed_at")
    )


@_query
def deployment_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = _warehouse(spark)
    _deploy(wh, sf_dir, deployed_at=_midnight_after_last_invoice(spark, sf_dir, 0))
    return publish.deployment_state(wh).select(
        "active_schema", F.col("deployed_at").cast("timestamp_ntz").alias("deployed_at")
    )


@_query
def deployment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = _warehouse(spark)
    _deploy(wh, sf_dir, deployed_at=_midnight_after_last_invoice(spark, sf_dir, 0))
    return publish.deployment_status(wh)


@_query
def rebuild_is_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh = _warehouse(spark)
    ledgers = []
    for _ in range(2):
        _deploy(wh, sf_dir)
        ledgers.append(publish.read_ledger(wh))
    return publish.idempotence(*ledgers)


# -- hand-over ----------------------------------------------------------------------------


def _published(spark: SparkSession, sf_dir: str) -> publish.Warehouse:
    wh = _warehouse(spark)
    _publish_as_is(wh, marts.mart_invoice_ledger(_ledger(spark, sf_dir)))
    return wh


@_query
def ledger_export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.export_json(_published(spark, sf_dir), work_folder(spark, "export"))


@_query
def ledger_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wh, out = _published(spark, sf_dir), work_folder(spark, "export")
    export.export_json(wh, out, ordered=True)
    return export.read_export(wh, out)


@_query
def failed_export_keeps_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers of an export get after the next one failed."""
    wh, out = _published(spark, sf_dir), work_folder(spark, "export")
    export.export_json(wh, out)
    _publish_as_is(wh, testbed.spoil_ledger(publish.read_ledger(wh)).select(*MART_V1.names))
    try:
        export.export_json(wh, out)
    except (PySparkException, Py4JJavaError):
        return export.read_export(wh, out)
    raise AssertionError("an export of spoilt rows went through")


@_query
def ledger_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.ledger_display(_ledger(spark, sf_dir))
