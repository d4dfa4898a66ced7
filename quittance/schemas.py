"""Declared schemas: the raw tables, the published ledger and its contract versions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The raw tables as the extracts declare them. Amounts arrive as text.
RAW_DDL = {
    "invoices": (
        "invoice_id INT, customer_id INT, amount STRING, status STRING, "
        "invoice_date DATE, due_date DATE"
    ),
    "customers": (
        "customer_id INT, customer_name STRING, country STRING, segment STRING, email STRING"
    ),
    "invoice_line_items": (
        "line_item_id INT, invoice_id INT, product_name STRING, quantity INT, unit_price STRING"
    ),
}

RAW_KEYS = {
    "invoices": ["invoice_id"],
    "customers": ["customer_id"],
    "invoice_line_items": ["invoice_id", "line_item_id"],
}

# The statuses and segments that readers may rely on.
INVOICE_STATUSES = ["paid", "overdue", "pending", "unknown"]
CUSTOMER_SEGMENTS = ["smb", "enterprise", "startup", "unknown"]


def raw_schema(table: str, wide_ids: bool = False) -> T.StructType:
    """Schema of one raw table; ``wide_ids`` holds ids beyond the 32-bit range."""
    schema = T.StructType.fromDDL(RAW_DDL[table])
    if not wide_ids:
        return schema
    return T.StructType(
        [
            T.StructField(f.name, T.LongType() if f.name.endswith("_id") else f.dataType, True)
            for f in schema.fields
        ]
    )


@dataclass(frozen=True)
class Column:
    """A column of a version; ``source`` is SQL over the totals, by default the same name."""

    name: str
    data_type: str
    required: bool = False
    check: str | None = None
    source: str | None = None


@dataclass(frozen=True)
class Contract:
    """One version of the published ledger.

    ``columns`` is the stored order, ``read_order`` the order readers get. Within a version
    nothing is renamed or removed; a breaking change is a new entry in ``CONTRACTS``, which may
    rename, derive, add or drop columns and has row rules of its own: fields that each row must
    have, those that must not be negative, and the values a field may take.
    """

    version: str
    dataset: str
    columns: tuple[Column, ...]
    read_order: tuple[str, ...]
    row_required: tuple[str, ...] = ()
    row_not_negative: tuple[str, ...] = ()
    row_allowed: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def types(self) -> dict[str, str]:
        return {c.name: c.data_type for c in self.columns}

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


# The published ledger and what a reader may rely on in each of its rows. The
# customer fields may be NULL and a discrepancy may be negative.
MART_V1 = Contract(
    version="v1",
    dataset="mart_invoice_ledger_v1",
    columns=(
        Column("invoice_id", "bigint", required=True),
        Column("invoice_amount", "double", required=True, check="invoice_amount >= 0"),
        Column("calculated_invoice_total", "double", required=True),
        Column("amount_discrepancy", "double", required=True),
        Column("invoice_date", "date", required=True),
        Column("invoice_due_date", "date", required=True),
        Column("invoice_status", "string", required=True),
        Column("customer_id", "bigint"),
        Column("customer_name", "string"),
        Column("customer_email", "string"),
        Column("customer_country", "string"),
        Column("customer_segment", "string"),
        Column("line_item_count", "bigint", required=True, check="line_item_count >= 0"),
        Column("payment_terms_days", "bigint"),
    ),
    read_order=(
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
    ),
    row_required=(
        "invoice_id",
        "line_item_count",
        "payment_terms_days",
        "invoice_amount",
        "calculated_invoice_total",
        "amount_discrepancy",
        "invoice_date",
        "invoice_due_date",
        "invoice_status",
    ),
    row_not_negative=("line_item_count", "invoice_amount", "calculated_invoice_total"),
    row_allowed=(("invoice_status", tuple(INVOICE_STATUSES)),),
)

CONTRACTS = {MART_V1.version: MART_V1}
LATEST_VERSION = MART_V1.version
