"""Handing the live ledger to consumers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.functions.display import currency, or_dash, short_date
from quittance.operators.contract import require_valid
from quittance.plans.publish import Warehouse, read_ledger
from quittance.schemas import LATEST_VERSION
from quittance.sources import files


def export_json(
    wh: Warehouse, out: str, version: str = LATEST_VERSION, ordered: bool = False
) -> DataFrame:
    """Write the live ledger as JSON lines under ``out`` and return its manifest.

    The rows go to a folder of their own. ``<out>/manifest.json`` is replaced last, in one step: it
    holds the row count, the contract version and the folder's name. A row that breaks the row
    contract fails the export, and what was exported before stays. NULLs are written out so that
    every row has every field. ``ordered`` sorts by invoice, at the price of a shuffle.
    """
    spark, folder = wh.spark, f"rows-{uuid.uuid4().hex}"
    ledger = read_ledger(wh, version)
    rows = require_valid(ledger, wh.contracts[version])
    if ordered:
        rows = rows.orderBy("invoice_id")
    try:
        rows.write.option("ignoreNullFields", False).json(f"{out}/{folder}")
    except Exception:
        files.delete(spark, f"{out}/{folder}")
        raise
    # All rows passed, so the count is the stored one, which Parquet keeps in its footers.
    manifest = {"count": ledger.count(), "version": version, "rows": folder}
    files.replace_text(spark, f"{out}/manifest.json", json.dumps(manifest))
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    schema = "count BIGINT, version STRING"
    return spark.read.schema(schema).json(f"{out}/manifest.json")


def rows_folder(spark: SparkSession, out: str) -> str:
    """The folder with the rows of the last export that succeeded."""
    manifest = files.read_text(spark, f"{out}/manifest.json")
    if manifest is None:
        raise LookupError(f"nothing has been exported to {out}")
    return f"{out}/{json.loads(manifest)['rows']}"


def read_export(wh: Warehouse, out: str, version: str = LATEST_VERSION) -> DataFrame:
    """The exported rows, typed as in the contract."""
    schema = read_ledger(wh, version).schema
    folder = rows_folder(wh.spark, out)
    return wh.spark.read.schema(schema).option("mode", "FAILFAST").json(folder)


def prune_exports(spark: SparkSession, out: str) -> None:
    """Delete the rows of all exports but the last."""
    present = rows_folder(spark, out).rsplit("/", 1)[1]
    for name in files.names_in(spark, out):
        if name.startswith("rows-") and name != present:
            files.delete(spark, f"{out}/{name}")


def ledger_display(ledger: DataFrame) -> DataFrame:
    """The ledger as people read it."""
    return ledger.select(
        "invoice_id",
        or_dash(F.col("customer_name")).alias("customer_name"),
        or_dash(F.col("customer_email")).alias("customer_email"),
        or_dash(F.col("customer_country")).alias("customer_country"),
        or_dash(F.col("customer_segment")).alias("customer_segment"),
        short_date(F.col("invoice_date")).alias("invoice_date"),
        short_date(F.col("invoice_due_date")).alias("invoice_due_date"),
        F.initcap("invoice_status").alias("invoice_status"),
        "line_item_count",
        currency(F.col("invoice_amount")).alias("invoice_amount"),
        currency(F.col("calculated_invoice_total")).alias("calculated_invoice_total"),
        currency(F.col("amount_discrepancy")).alias("amount_discrepancy"),
        "payment_terms_days",
    )
