"""From staging tables to the invoice ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.functions.money import difference, exact_sum
from quittance.operators.spread import HotKeys, left_join
from quittance.schemas import MART_V1, Contract

LINE_AMOUNT = "quantity * unit_price"


def line_totals_detail(lines: DataFrame) -> DataFrame:
    """Every line with its own total."""
    return lines.withColumn("line_total", F.expr(LINE_AMOUNT))


def invoice_line_totals(lines: DataFrame) -> DataFrame:
    """Line count and total per invoice.

    Lines arrive spread by (invoice, line) and are added up before the shuffle by invoice, so
    an invoice with a huge number of lines reaches its reducer as one row per task.
    """
    return lines.groupBy("invoice_id").agg(
        F.count("line_item_id").alias("line_item_count"),
        exact_sum(F.col("unit_price"), F.col("quantity")).alias("calculated_invoice_total"),
    )


def invoice_customer_enrich(
    invoices: DataFrame, customers: DataFrame, hot: HotKeys = HotKeys()
) -> DataFrame:
    """Invoices with their customer's columns, NULL where there is no such customer."""
    return left_join(invoices, customers, "customer_id", "invoice_id", hot).select(
        *invoices.columns, *[c for c in customers.columns if c != "customer_id"]
    )


def invoice_amounts(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per invoice with its terms, line count, total and discrepancy.

    All that can be said of an invoice without its customer. The line totals arrive partitioned
    by invoice, as the invoices are.
    """
    total = F.coalesce("calculated_invoice_total", F.lit(0.0))
    return invoices.join(invoice_line_totals(lines), "invoice_id", "left").select(
        *invoices.columns,
        F.datediff("invoice_due_date", "invoice_date").cast("bigint").alias("payment_terms_days"),
        F.coalesce("line_item_count", F.lit(0).cast("bigint")).alias("line_item_count"),
        total.alias("calculated_invoice_total"),
        difference(F.col("invoice_amount"), total).alias("amount_discrepancy"),
    )


def int_invoice_totals(
    invoices: DataFrame, customers: DataFrame, lines: DataFrame, hot: HotKeys = HotKeys()
) -> DataFrame:
    """The amounts of every invoice with its customer's columns.

    Lines are joined first, on the partitioning the invoices already have; only then are the
    rows moved to their customers.
    """
    enriched = invoice_customer_enrich(invoice_amounts(invoices, lines), customers, hot)
    return enriched.select(
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
    )


def mart_invoice_ledger(totals: DataFrame, contract: Contract = MART_V1) -> DataFrame:
    """The ledger as one version of its contract stores it: renamed, derived, in its order."""
    return totals.select(*[F.expr(c.source or c.name).alias(c.name) for c in contract.columns])
