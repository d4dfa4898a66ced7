from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quittance.operators import contract as K
from quittance.schemas import MART_V1

DDL = ", ".join(f"{c.name} {c.data_type}" for c in MART_V1.columns)
GOOD = {
    "invoice_id": 501,
    "invoice_amount": 120.5,
    "calculated_invoice_total": 120.5,
    "amount_discrepancy": 0.0,
    "invoice_date": date(2025, 1, 10),
    "invoice_due_date": date(2025, 2, 9),
    "invoice_status": "paid",
    "customer_id": 3,
    "customer_name": "Harbour Bakery",
    "customer_email": "till@harbour.example",
    "customer_country": "PT",
    "customer_segment": "smb",
    "line_item_count": 2,
    "payment_terms_days": 30,
}
NO_CUSTOMER = dict.fromkeys(
    ["customer_id", "customer_name", "customer_email", "customer_country", "customer_segment"]
)


def _ledger(spark, *changes):
    return spark.createDataFrame([{**GOOD, **c} for c in changes], DDL)


@pytest.mark.parametrize(
    "change",
    [
        {},
        {"customer_email": None},
        {"customer_id": None},
        NO_CUSTOMER,
        *[{"invoice_status": s} for s in ("paid", "overdue", "pending", "unknown")],
        {"amount_discrepancy": -25.5},
        {"payment_terms_days": -4},
        {
            "line_item_count": 0,
            "invoice_amount": 0.0,
            "calculated_invoice_total": 0.0,
            "amount_discrepancy": 0.0,
        },
    ],
)
def test_accepted_rows(spark, change):
    df = _ledger(spark, change)
    assert K.valid_rows(df).count() == 1
    assert K.rejected_rows(df).count() == 0
    assert K.require_valid(df).first().asDict() == {**GOOD, **change}


@pytest.mark.parametrize(
    ("change", "codes"),
    [
        ({"invoice_status": "deleted"}, "invoice_status:not_allowed"),
        ({"invoice_status": ""}, "invoice_status:not_allowed"),
        ({"line_item_count": -1}, "line_item_count:negative"),
        ({"invoice_amount": -100.0}, "invoice_amount:negative"),
        ({"invoice_amount": math.nan}, "invoice_amount:negative"),
        ({"calculated_invoice_total": -50.0}, "calculated_invoice_total:negative"),
        ({"invoice_id": None}, "invoice_id:missing"),
        ({"payment_terms_days": None}, "payment_terms_days:missing"),
        (
            {"invoice_date": None, "line_item_count": -3},
            "invoice_date:missing,line_item_count:negative",
        ),
    ],
)
def test_rejected_rows(spark, change, codes):
    df = _ledger(spark, {}, change)
    assert K.valid_rows(df).count() == 1
    assert [r["violations"] for r in K.rejected_rows(df).collect()] == [codes]
    with pytest.raises(PySparkException, match="row contract"):
        K.require_valid(df).collect()


def test_no_rows_are_valid(spark):
    empty = _ledger(spark, {}).where("false")
    assert K.require_valid(empty).count() == 0


def test_schema_drift(spark):
    df = _ledger(spark, {})
    assert K.schema_drift(df, MART_V1) == []
    drifted = (
        df.drop("customer_email")
        .withColumn("line_item_count", F.col("line_item_count").cast("int"))
        .withColumn("note", F.lit("x"))
    )
    assert K.schema_drift(drifted, MART_V1) == [
        "customer_email is missing",
        "note is not in the contract",
        "line_item_count is int, declared bigint",
    ]
    with pytest.raises(K.ContractDrift, match="customer_email is missing"):
        K.enforce(drifted, MART_V1)
    status = {r["column_name"]: r["status"] for r in K.schema_report(drifted, MART_V1).collect()}
    assert len(status) == 14
    assert {c for c, s in status.items() if s == "drift"} == {"customer_email", "line_item_count"}


def test_column_order_is_the_declared_one(spark):
    shuffled = _ledger(spark, {}).select(*sorted(MART_V1.names))
    assert K.enforce(shuffled, MART_V1).columns == MART_V1.names


@pytest.mark.parametrize(
    "change",
    [{"invoice_date": None}, {"invoice_amount": -0.01}, {"line_item_count": -1}],
)
def test_a_breached_constraint_fails_the_write(spark, tmp_path, change):
    df = _ledger(spark, {}, change)
    out = str(tmp_path / "mart")
    with pytest.raises(PySparkException, match=K.BREACH):
        K.enforce(df, MART_V1).write.parquet(out)
    assert not (tmp_path / "mart" / "_SUCCESS").exists()


def test_optional_columns_may_be_null(spark, tmp_path):
    df = _ledger(spark, {**NO_CUSTOMER, "payment_terms_days": None})
    K.enforce(df, MART_V1).write.parquet(str(tmp_path / "mart"))


def test_constraint_report(spark):
    changes = [{"invoice_date": None}, {"invoice_amount": -1.0}, {"invoice_amount": None}]
    df = _ledger(spark, {}, *changes)
    found = {
        (r["column_name"], r["constraint_kind"]): r["breaches"]
        for r in K.constraint_report(df, MART_V1).collect()
    }
    assert len(found) == 10
    assert {k: n for k, n in found.items() if n} == {
        ("invoice_date", "not_null"): 1,
        ("invoice_amount", "not_null"): 1,
        ("invoice_amount", "check"): 1,
    }
