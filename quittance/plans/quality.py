"""The checks of the receivables models and the reports over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.functions.money import SCALE
from quittance.operators.checks import (
    Check,
    accepted_values,
    assertion,
    not_negative,
    not_null,
    orphans,
    run_checks,
    unique,
)
from quittance.plans.marts import LINE_AMOUNT
from quittance.schemas import CUSTOMER_SEGMENTS, INVOICE_STATUSES

STAGING_MODELS = ("stg_invoices", "stg_customers", "stg_invoice_line_items")
LEDGER_MODELS = ("int_invoice_totals", "mart_invoice_ledger")


def declared_checks(segments: Sequence[str] = CUSTOMER_SEGMENTS) -> list[Check]:
    """The 46 gating column checks and the 2 row assertions, which are switched off."""
    # Which property is asked of which column.
    inv, cust, line = STAGING_MODELS
    tot, mart = LEDGER_MODELS
    return [
        unique(inv, "invoice_id"),
        *not_null(
            inv,
            "invoice_id",
            "customer_id",
            "invoice_date",
            "invoice_due_date",
            "invoice_amount",
            "invoice_status",
        ),
        *not_negative(inv, "invoice_amount"),
        accepted_values(inv, "invoice_status", INVOICE_STATUSES),
        unique(cust, "customer_id"),
        *not_null(cust, "customer_id", "customer_segment"),
        accepted_values(cust, "customer_segment", segments),
        *not_null(line, "line_item_id", "invoice_id", "quantity", "unit_price"),
        *not_negative(line, "quantity", "unit_price"),
        unique(tot, "invoice_id"),
        *not_null(
            tot,
            "invoice_id",
            "invoice_amount",
            "invoice_date",
            "invoice_due_date",
            "payment_terms_days",
            "line_item_count",
            "calculated_invoice_total",
            "amount_discrepancy",
        ),
        *not_negative(tot, "invoice_amount", "line_item_count", "calculated_invoice_total"),
        accepted_values(tot, "customer_segment", segments),
        accepted_values(tot, "invoice_status", INVOICE_STATUSES),
        unique(mart, "invoice_id"),
        *not_null(
            mart,
            "invoice_id",
            "invoice_amount",
            "calculated_invoice_total",
            "amount_discrepancy",
            "invoice_date",
            "invoice_due_date",
            "invoice_status",
            "line_item_count",
            "payment_terms_days",
        ),
        *not_negative(mart, "invoice_amount", "line_item_count"),
        accepted_values(mart, "invoice_status", INVOICE_STATUSES),
        assertion(mart, "assert_all_invoices_have_customers", "true", advisory=False),
        assertion(mart, "assert_no_line_items_have_zero_total", "true", advisory=False),
    ]


# Assertions that legitimate data may break; they warn and never hold back a publish.
HAS_CUSTOMER = "customer_name is not null"
AMOUNT_HAS_LINES = "line_item_count != 0 or invoice_amount = 0"
NO_LINES_NO_TOTAL = "line_item_count != 0 or calculated_invoice_total = 0"
DUE_AFTER_ISSUE = "invoice_due_date >= invoice_date"

ADVISORY_CHECKS = [
    assertion("mart_invoice_ledger", "invoice_has_customer", HAS_CUSTOMER),
    assertion("mart_invoice_ledger", "amount_has_lines", AMOUNT_HAS_LINES),
    assertion("mart_invoice_ledger", "no_lines_no_total", NO_LINES_NO_TOTAL),
    assertion("mart_invoice_ledger", "due_after_issue", DUE_AFTER_ISSUE),
]


def checks_of(checks: Sequence[Check], *models: str) -> list[Check]:
    return [c for c in checks if c.model in models]


def report(
    staged: dict[str, DataFrame],
    ledger: DataFrame,
    checks: Sequence[Check],
    stored: bool = False,
) -> DataFrame:
    """One row per check over the staging tables and the ledger.

    The intermediate model and the mart hold the same rows and columns, so the ledger serves
    the checks of both.
    """
    parts = []
    for model, df in staged.items():
        here = checks_of(checks, model)
        if here and model == "stg_invoice_line_items" and not stored:
            parts.append(_line_report(df, here))
        elif here:
            parts.append(run_checks(df, here, stored))
    on_ledger = checks_of(checks, *LEDGER_MODELS)
    if on_ledger:
        # The ledger lies by customer, so its invoices are not clustered.
        parts.append(run_checks(ledger, on_ledger, stored, clustered=False))
    return reduce(DataFrame.unionAll, parts)


def _line_report(lines: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The report on computed lines, those without an invoice counted apart.

    The ledger takes only lines that have one, so Spark looks for them before the dedup. Asking
    for the same lines here lets it reuse that dedup, the largest shuffle there is. The others
    are few or none, and found by a filter that reaches the scan.
    """
    if any(c.kind == "unique" for c in checks):
        return run_checks(lines, checks)
    with_invoice, without = (lines.where(f"invoice_id IS {n}") for n in ("NOT NULL", "NULL"))
    found = run_checks(with_invoice, checks).unionAll(run_checks(without, checks))
    return found.groupBy("check_id", "model", "column_name", "kind").agg(
        F.sum("failures").alias("failures"), F.max_by("status", "failures").alias("status")
    )


def breaking(df: DataFrame, expression: str) -> DataFrame:
    """The rows for which ``expression`` is false."""
    return df.where(~F.expr(expression))


def wrong_line_totals(line_totals: DataFrame) -> DataFrame:
    """Lines whose total is not quantity times price."""
    return line_totals.where(F.abs(F.col("line_total") - F.expr(LINE_AMOUNT)) > 10.0**-SCALE)


def _reckoned(lines: DataFrame) -> DataFrame:
    """(invoice_id, line_sum, slack): totals by another way than the ledger's, to check it by.

    The amounts of lines are decimals of 18 places, which are exact for prices below 10**9 and
    rounded once as a sum. Where a price or the sum is larger they are added as DOUBLE, and
    ``slack`` is what that addition may be off by.
    """
    price, quantity = F.col("unit_price"), F.col("quantity")
    near = F.abs(price) < 1e9
    exact = F.when(near, price).try_cast("decimal(27,18)") * quantity.cast("decimal(10,0)")
    sums = lines.groupBy("invoice_id").agg(
        F.try_sum(exact).alias("exact"),
        F.count_if(~near & quantity.isNotNull()).alias("far"),
        F.sum(price * quantity).alias("rough"),
        F.sum(F.abs(price * quantity)).alias("size"),
    )
    is_exact = (F.col("far") == 0) & F.col("exact").isNotNull()
    return sums.select(
        "invoice_id",
        F.when(is_exact, F.round("exact", SCALE).cast("double")).otherwise(F.col("rough")).alias("line_sum"),
        F.when(~is_exact & (F.col("size") < 1e300), F.col("size") * 1e-12)
        .otherwise(F.lit(0.0))
        .alias("slack"),
    )


def unreconciled(ledger: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoices whose total is not the sum of their lines, added up by another way."""
    gap = F.abs(F.col("calculated_invoice_total") - F.col("line_sum"))
    return (
        ledger.select("invoice_id", "calculated_invoice_total")
        .join(_reckoned(lines), "invoice_id", "left")
        .withColumn("line_sum", F.coalesce("line_sum", F.lit(0.0)))
        .where(gap > F.coalesce("slack", F.lit(0.0)) + 10.0**-SCALE)
        .drop("slack")
    )


def relationships(staged: dict[str, DataFrame]) -> DataFrame:
    """References without a target: lines to invoices and invoices to customers."""
    invoices, customers, lines = (staged[m] for m in STAGING_MODELS)
    return (
        orphans(lines, "invoice_id", invoices, "invoice_id")
        .select(
            F.lit("stg_invoice_line_items").alias("child"),
            F.lit("stg_invoices").alias("parent"),
            "key_value",
            "child_rows",
        )
        .unionAll(
            orphans(invoices, "customer_id", customers, "customer_id").select(
                F.lit("stg_invoices"), F.lit("stg_customers"), "key_value", "child_rows"
            )
        )
    )
