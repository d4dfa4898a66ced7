"""Staging: one clean, typed row per key of each raw table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.functions.text import blank_to_null, lower, or_unknown, strip, to_double, upper
from quittance.operators.dedup import keep_first
from quittance.operators.spread import HotKeys
from quittance.schemas import RAW_KEYS


def _one_per_key(
    raw: DataFrame, table: str, cluster_by: Sequence[str] | None = None
) -> DataFrame:
    # Ids are widened before the shuffle: a cast after it would hide from Spark that the rows
    # already lie where the joins on these ids want them.
    ids = {c: F.col(c).cast("bigint") for c in raw.columns if c.endswith("_id")}
    return keep_first(raw.withColumns(ids), RAW_KEYS[table], cluster_by)


def stg_invoices(raw: DataFrame) -> DataFrame:
    return _one_per_key(raw, "invoices").select(
        "invoice_id",
        "customer_id",
        to_double(F.col("amount")).alias("invoice_amount"),
        or_unknown(strip(lower(F.col("status")))).alias("invoice_status"),
        "invoice_date",
        F.col("due_date").alias("invoice_due_date"),
    )


def stg_customers(raw: DataFrame) -> DataFrame:
    return _one_per_key(raw, "customers").select(
        "customer_id",
        blank_to_null(strip(F.col("customer_name"))).alias("customer_name"),
        blank_to_null(strip(upper(F.col("country")))).alias("customer_country"),
        or_unknown(lower(strip(F.col("segment")))).alias("customer_segment"),
        blank_to_null(lower(strip(F.col("email")))).alias("customer_email"),
    )


def stg_invoice_line_items(raw: DataFrame, hot_invoices: HotKeys | None = None) -> DataFrame:
    """Clean lines.

    When the lines are known to have no hot invoice, they are shuffled by invoice alone. Their
    totals and the join with the invoices then need no shuffle of their own. Otherwise they are
    spread by invoice and line.
    """
    even = hot_invoices is not None and not hot_invoices
    lines = _one_per_key(raw, "invoice_line_items", ["invoice_id"] if even else None)
    return lines.select(
        "line_item_id",
        "invoice_id",
        blank_to_null(strip(F.col("product_name"))).alias("product_name"),
        F.col("quantity").cast("int").alias("quantity"),
        to_double(F.col("unit_price")).alias("unit_price"),
    )


def stage(
    raw: dict[str, DataFrame], hot_invoices: HotKeys | None = None
) -> dict[str, DataFrame]:
    """All staging tables, lazily."""
    return {
        "stg_invoices": stg_invoices(raw["invoices"]),
        "stg_customers": stg_customers(raw["customers"]),
        "stg_invoice_line_items": stg_invoice_line_items(raw["invoice_line_items"], hot_invoices),
    }
