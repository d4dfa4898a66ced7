"""The registered queries in ANSI SQL, written apart from the Spark code to check it."""

from __future__ import annotations

from typing import NamedTuple


class _Check(NamedTuple):
    """A check as the data owner states it; ``bad`` is SQL that is true for a failing row."""

    check_id: str
    model: str
    column: str
    kind: str
    bad: str
    found: str = "fail"


_STATUSES = "'paid', 'overdue', 'pending', 'unknown'"
_SEGMENTS = "'smb', 'enterprise', 'startup', 'unknown'"
_OWN_SEGMENTS = "'automobile', 'building', 'furniture', 'household', 'machinery', 'unknown'"


def _checks(segments: str) -> list[_Check]:
    """The 46 column checks and the 2 assertions that are switched off."""
    listed = [
        ("unique", "stg_invoices", "invoice_id"),
        ("not_null", "stg_invoices", "invoice_id"),
        ("not_null", "stg_invoices", "customer_id"),
        ("not_null", "stg_invoices", "invoice_date"),
        ("not_null", "stg_invoices", "invoice_due_date"),
        ("not_null", "stg_invoices", "invoice_amount"),
        ("not_null", "stg_invoices", "invoice_status"),
        ("expression_is_true", "stg_invoices", "invoice_amount"),
        ("accepted_values", "stg_invoices", "invoice_status"),
        ("unique", "stg_customers", "customer_id"),
        ("not_null", "stg_customers", "customer_id"),
        ("not_null", "stg_customers", "customer_segment"),
        ("accepted_values", "stg_customers", "customer_segment"),
        ("not_null", "stg_invoice_line_items", "line_item_id"),
        ("not_null", "stg_invoice_line_items", "invoice_id"),
        ("not_null", "stg_invoice_line_items", "quantity"),
        ("not_null", "stg_invoice_line_items", "unit_price"),
        ("expression_is_true", "stg_invoice_line_items", "quantity"),
        ("expression_is_true", "stg_invoice_line_items", "unit_price"),
        ("unique", "int_invoice_totals", "invoice_id"),
        ("not_null", "int_invoice_totals", "invoice_id"),
        ("not_null", "int_invoice_totals", "invoice_amount"),
        ("not_null", "int_invoice_totals", "invoice_date"),
        ("not_null", "int_invoice_totals", "invoice_due_date"),
        ("not_null", "int_invoice_totals", "payment_terms_days"),
        ("not_null", "int_invoice_totals", "line_item_count"),
        ("not_null", "int_invoice_totals", "calculated_invoice_total"),
        ("not_null", "int_invoice_totals", "amount_discrepancy"),
        ("expression_is_true", "int_invoice_totals", "invoice_amount"),
        ("expression_is_true", "int_invoice_totals", "line_item_count"),
        ("expression_is_true", "int_invoice_totals", "calculated_invoice_total"),
        ("accepted_values", "int_invoice_totals", "customer_segment"),
        ("accepted_values", "int_invoice_totals", "invoice_status"),
        ("unique", "mart_invoice_ledger", "invoice_id"),
        ("not_null", "mart_invoice_ledger", "invoice_id"),
        ("not_null", "mart_invoice_ledger", "invoice_amount"),
        ("not_null", "mart_invoice_ledger", "calculated_invoice_total"),
        ("not_null", "mart_invoice_ledger", "amount_discrepancy"),
        ("not_null", "mart_invoice_ledger", "invoice_date"),
        ("not_null", "mart_invoice_ledger", "invoice_due_date"),
        ("not_null", "mart_invoice_ledger", "invoice_status"),
        ("not_null", "mart_invoice_ledger", "line_item_count"),
        ("not_null", "mart_invoice_ledger", "payment_terms_days"),
        ("expression_is_true", "mart_invoice_ledger", "invoice_amount"),
        ("expression_is_true", "mart_invoice_ledger", "line_item_count"),
        ("accepted_values", "mart_invoice_ledger", "invoice_status"),
    ]
    values = {"invoice_status": _STATUSES, "customer_segment": segments}
    bad = {
        "unique": "",
        "not_null": "{c} IS NULL",
        "expression_is_true": "NOT ({c} >= 0)",
        "accepted_values": "{c} NOT IN ({v})",
    }
    found = [
        _Check(f"{kind}_{model}_{c}", model, c, kind, bad[kind].format(c=c, v=values.get(c, "")))
        for kind, model, c in listed
    ]
    off = ("assert_all_invoices_have_customers", "assert_no_line_items_have_zero_total")
    return found + [_Check(n, "mart_invoice_ledger", "", "singular", "false") for n in off]


_ADVISORY = [
    _Check("invoice_has_customer", "mart_invoice_ledger", "", "singular", "customer_name IS NULL", "warn"),
    _Check(
        "amount_has_lines",
        "mart_invoice_ledger",
        "",
        "singular",
        "line_item_count = 0 AND invoice_amount <> 0",
        "warn",
    ),
    _Check(
        "no_lines_no_total",
        "mart_invoice_ledger",
        "",
        "singular",
        "line_item_count = 0 AND calculated_invoice_total <> 0",
        "warn",
    ),
    _Check(
        "due_after_issue", "mart_invoice_ledger", "", "singular", "invoice_due_date < invoice_date", "warn"
    ),
]

# Name, type and whether it must be there, in stored order.
_CONTRACT = [
    ("invoice_id", "bigint", True),
    ("invoice_amount", "double", True),
    ("calculated_invoice_total", "double", True),
    ("amount_discrepancy", "double", True),
    ("invoice_date", "date", True),
    ("invoice_due_date", "date", True),
    ("invoice_status", "string", True),
    ("customer_id", "bigint", False),
    ("customer_name", "string", False),
    ("customer_email", "string", False),
    ("customer_country", "string", False),
    ("customer_segment", "string", False),
    ("line_item_count", "bigint", True),
    ("payment_terms_days", "bigint", False),
]

_RAW = """
invoice_rows AS (
  SELECT o_orderkey AS invoice_id,
         CASE WHEN o_orderkey % 97 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS customer_id,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
         CASE WHEN o_orderkey % 50 = 0 THEN NULL
              WHEN o_orderstatus = 'F' THEN ' PAID '
              WHEN o_orderstatus = 'O' THEN 'Pending'
              ELSE 'overdue' END AS status,
         CAST(o_orderdate AS DATE) AS invoice_date,
         CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 101 = 0 THEN -2
              ELSE 10 * CAST(substr(o_orderpriority, 1, 1) AS INT) END AS due_date
  FROM orders),
raw_invoices AS (
  SELECT * FROM invoice_rows UNION ALL SELECT * FROM invoice_rows WHERE invoice_id % 10 = 3),
raw_customers AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN c_custkey % 40 = 0 THEN '  ' ELSE ' ' || c_name || ' ' END AS customer_name,
         CASE WHEN c_custkey % 33 = 0 THEN '' ELSE lower(n_name) END AS country,
         CASE WHEN c_custkey % 21 = 0 THEN NULL ELSE c_mktsegment END AS segment,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name || '@Example.com' END AS email
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
raw_line_items AS (
  SELECT CAST(l_linenumber AS BIGINT) AS line_item_id, l_orderkey AS invoice_id,
         p_name AS product_name, CAST(l_quantity AS INT) AS quantity,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS unit_price
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

# From here on only raw_invoices, raw_customers and raw_line_items are needed.
_STAGING = """
stg_invoices AS MATERIALIZED (
  SELECT invoice_id, customer_id, CAST(amount AS DOUBLE) AS invoice_amount,
         COALESCE(TRIM(LOWER(status)), 'unknown') AS invoice_status,
         invoice_date, due_date AS invoice_due_date
  FROM raw_invoices
  QUALIFY ROW_NUMBER() OVER (PARTITION BY invoice_id
    ORDER BY customer_id NULLS LAST, amount NULLS LAST, status NULLS LAST,
             invoice_date NULLS LAST, due_date NULLS LAST) = 1),
stg_customers AS MATERIALIZED (
  SELECT customer_id, NULLIF(TRIM(customer_name), '') AS customer_name,
         NULLIF(TRIM(UPPER(country)), '') AS customer_country,
         COALESCE(LOWER(TRIM(segment)), 'unknown') AS customer_segment,
         NULLIF(LOWER(TRIM(email)), '') AS customer_email
  FROM raw_customers
  QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id
    ORDER BY customer_name NULLS LAST, country NULLS LAST, segment NULLS LAST,
             email NULLS LAST) = 1),
stg_invoice_line_items AS MATERIALIZED (
  SELECT line_item_id, invoice_id, NULLIF(TRIM(product_name), '') AS product_name,
         quantity, CAST(unit_price AS DOUBLE) AS unit_price
  FROM raw_line_items
  QUALIFY ROW_NUMBER() OVER (PARTITION BY line_item_id, invoice_id
    ORDER BY product_name NULLS LAST, quantity NULLS LAST, unit_price NULLS LAST) = 1)"""

_TOTALS = """
line_totals AS MATERIALIZED (
  SELECT invoice_id, COUNT(line_item_id) AS line_item_count,
         CAST(ROUND(SUM(quantity * CAST(unit_price AS DECIMAL(28,9))), 6) AS DOUBLE)
           AS calculated_invoice_total
  FROM stg_invoice_line_items GROUP BY invoice_id),
ledger AS MATERIALIZED (
  SELECT i.invoice_id, i.customer_id, c.customer_name, c.customer_country, c.customer_segment,
         c.customer_email, i.invoice_amount, i.invoice_status, i.invoice_date,
         i.invoice_due_date,
         DATEDIFF('day', i.invoice_date, i.invoice_due_date) AS payment_terms_days,
         COALESCE(t.line_item_count, 0) AS line_item_count,
         COALESCE(t.calculated_invoice_total, 0.0) AS calculated_invoice_total,
         ROUND(i.invoice_amount - COALESCE(t.calculated_invoice_total, 0.0), 6)
           AS amount_discrepancy
  FROM stg_invoices i
  LEFT JOIN stg_customers c ON i.customer_id = c.customer_id
  LEFT JOIN line_totals t ON i.invoice_id = t.invoice_id)"""

_STAGED = f"{_RAW},{_STAGING}"
_LEDGER = f"{_STAGED},{_TOTALS}"

_SPOILT = (
    _LEDGER
    + """,
spoilt AS MATERIALIZED (
  SELECT * REPLACE (
    CASE WHEN invoice_id % 31 = 0 THEN -invoice_amount - 1
         WHEN invoice_id % 59 = 0 THEN CAST('NaN' AS DOUBLE)
         ELSE invoice_amount END AS invoice_amount,
    CASE WHEN invoice_id % 37 = 0 THEN 'deleted' ELSE invoice_status END AS invoice_status,
    CASE WHEN invoice_id % 41 = 0 THEN -1 ELSE line_item_count END AS line_item_count,
    CASE WHEN invoice_id % 43 = 0 THEN -50.0
         WHEN invoice_id % 29 = 0 THEN calculated_invoice_total + 1
         ELSE calculated_invoice_total END AS calculated_invoice_total,
    CASE WHEN invoice_id % 47 = 0 THEN NULL ELSE invoice_date END AS invoice_date,
    CASE WHEN invoice_id % 53 = 0 THEN NULL ELSE payment_terms_days END AS payment_terms_days)
  FROM ledger)"""
)

_VIOLATIONS = """concat_ws(',',
    CASE WHEN invoice_id IS NULL THEN 'invoice_id:missing' END,
    CASE WHEN line_item_count IS NULL THEN 'line_item_count:missing' END,
    CASE WHEN payment_terms_days IS NULL THEN 'payment_terms_days:missing' END,
    CASE WHEN invoice_amount IS NULL THEN 'invoice_amount:missing' END,
    CASE WHEN calculated_invoice_total IS NULL THEN 'calculated_invoice_total:missing' END,
    CASE WHEN amount_discrepancy IS NULL THEN 'amount_discrepancy:missing' END,
    CASE WHEN invoice_date IS NULL THEN 'invoice_date:missing' END,
    CASE WHEN invoice_due_date IS NULL THEN 'invoice_due_date:missing' END,
    CASE WHEN invoice_status IS NULL THEN 'invoice_status:missing' END,
    CASE WHEN line_item_count < 0 THEN 'line_item_count:negative' END,
    CASE WHEN invoice_amount < 0 OR isnan(invoice_amount) THEN 'invoice_amount:negative' END,
    CASE WHEN calculated_invoice_total < 0 THEN 'calculated_invoice_total:negative' END,
    CASE WHEN invoice_status NOT IN ('paid', 'overdue', 'pending', 'unknown')
         THEN 'invoice_status:not_allowed' END)"""


def _on(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


_LEDGER_ROWS = _on(_LEDGER, "SELECT * FROM ledger")

# The ledger over raw tables that are already there.
LEDGER_FROM_RAW = _on(f"{_STAGING},{_TOTALS}", "SELECT * FROM ledger")


def _relation(model: str) -> str:
    return "ledger" if model in ("int_invoice_totals", "mart_invoice_ledger") else model


def _failures(check: _Check, relation: str) -> str:
    """A scalar query counting the failures of one check."""
    c = check.column
    if check.kind == "unique":
        return (
            f"(SELECT COUNT(*) FROM (SELECT {c} FROM {relation} WHERE {c} IS NOT NULL "
            f"GROUP BY {c} HAVING COUNT(*) > 1))"
        )
    return f"(SELECT COUNT(*) FROM {relation} WHERE {check.bad})"


def _report(checks: list[_Check]) -> str:
    union = "\nUNION ALL ".join(
        f"SELECT '{c.check_id}' AS check_id, '{c.model}' AS model, "
        f"'{c.column}' AS column_name, '{c.kind}' AS kind, "
        f"{_failures(c, _relation(c.model))} AS failures, '{c.found}' AS found"
        for c in checks
    )
    return (
        "SELECT check_id, model, column_name, kind, failures, "
        f"CASE WHEN failures > 0 THEN found ELSE 'pass' END AS status FROM ({union})"
    )


def _row_wise(kind: str) -> str:
    checks = [c for c in _checks(_OWN_SEGMENTS) if c.kind == kind]
    rows = [(c, c.model, _relation(c.model)) for c in checks]
    rows += [(c, "spoilt_ledger", "spoilt") for c in checks if c.model == "mart_invoice_ledger"]
    union = "\nUNION ALL ".join(
        f"SELECT '{model}' AS model, '{c.column}' AS column_name, "
        f"{_failures(c, relation)} AS failures"
        for c, model, relation in rows
    )
    return _on(
        _SPOILT,
        "SELECT model, column_name, failures, "
        f"CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS status FROM ({union})",
    )


def _gate() -> str:
    parts = []
    for name, segments in (("own lists", _OWN_SEGMENTS), ("default lists", _SEGMENTS)):
        failing = f"(SELECT COUNT(*) FROM ({_report(_checks(segments))}) WHERE status = 'fail')"
        parts.append(
            f"SELECT '{name}' AS segments, target, total_failures, CAST(0 AS BIGINT) AS "
            "missing_checks, target <> 'dev' AND total_failures = 0 AS publish "
            f"FROM (VALUES ('dev'), ('blue'), ('green')) AS t(target), "
            f"(SELECT {failing} AS total_failures)"
        )
    return _on(_LEDGER, "\nUNION ALL ".join(parts))


def _schema_report() -> str:
    rows = []
    for name, kind, required in _CONTRACT:
        status = "CASE WHEN null_rows > 0 THEN 'nulls' ELSE 'ok' END" if required else "'ok'"
        rows.append(
            f"SELECT '{name}' AS column_name, '{kind}' AS declared_type, '{kind}' AS actual_type, "
            f"{str(required).lower()} AS is_required, null_rows, {status} AS status "
            f"FROM (SELECT COUNT(*) - COUNT({name}) AS null_rows FROM ledger)"
        )
    return _on(_LEDGER, "\nUNION ALL ".join(rows))


def _constraints() -> str:
    rows = [(c, "not_null", f"{c} IS NULL") for c, _, required in _CONTRACT if required]
    rows += [(c, "check", f"{c} < 0") for c in ("invoice_amount", "line_item_count")]
    return _on(
        _SPOILT,
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{kind}' AS constraint_kind, "
            f"(SELECT COUNT(*) FROM spoilt WHERE {bad}) AS breaches"
            for c, kind, bad in rows
        ),
    )


def _repeated(model: str, keys: str, relation: str, value: str) -> str:
    return (
        f"SELECT '{model}' AS model, '{keys}' AS column_name, {value} AS key_value, "
        f"COUNT(*) AS n_records FROM {relation} GROUP BY {keys} HAVING COUNT(*) > 1"
    )


def _outside(model: str, relation: str, column: str, values: str) -> str:
    return (
        f"SELECT '{model}' AS model, '{column}' AS column_name, {column} AS value, "
        f"COUNT(*) AS n_records FROM {relation} WHERE {column} NOT IN ({values}) "
        f"GROUP BY {column}"
    )




def _money(c: str) -> str:
    return (
        f"CASE WHEN {c} < 0 THEN '-$' ELSE '$' END || format('{{:,.2f}}', abs(round({c}, 2)))"
    )


def _dash(c: str) -> str:
    return f"COALESCE({c}, '—') AS {c}"


_DISPLAY = f"""SELECT invoice_id, {_dash("customer_name")}, {_dash("customer_email")},
  {_dash("customer_country")}, {_dash("customer_segment")},
  strftime(invoice_date, '%b %-d, %Y') AS invoice_date,
  strftime(invoice_due_date, '%b %-d, %Y') AS invoice_due_date,
  upper(invoice_status[1]) || invoice_status[2:] AS invoice_status, line_item_count,
  {_money("invoice_amount")} AS invoice_amount,
  {_money("calculated_invoice_total")} AS calculated_invoice_total,
  {_money("amount_discrepancy")} AS amount_discrepancy, payment_terms_days
FROM ledger"""

_NORMALISED = """
WITH messy AS (
  SELECT c_custkey AS customer_id,
         CASE c_custkey % 5 WHEN 0 THEN chr(160) || chr(12288) || c_name || ' ' || chr(8195)
              WHEN 1 THEN chr(9) || c_name || chr(10) || ' '
              WHEN 2 THEN ' ' || chr(160) || ' '
              WHEN 3 THEN NULL ELSE c_name END AS padded,
         CASE c_custkey % 3 WHEN 0 THEN ' Straße ﬁ ' || c_mktsegment
              WHEN 1 THEN ' İzmir ΟΔΟΣ ' || c_mktsegment END AS letters
  FROM customer)
SELECT customer_id, NULLIF(TRIM(padded), '') AS name,
       NULLIF(TRIM(UPPER(letters)), '') AS country,
       COALESCE(LOWER(TRIM(letters)), 'unknown') AS segment,
       NULLIF(LOWER(TRIM(padded)), '') AS email,
       COALESCE(TRIM(LOWER(padded)), 'unknown') AS status
FROM messy"""

# Prices in billionths are whole numbers; half a millionth is rounded up once, in the total.
_SMALL_PRICES = """
lines AS (
  SELECT line_item_id, invoice_id, quantity,
         CAST(CAST(unit_price AS DECIMAL(18,2)) * 100 AS HUGEINT) AS billionths
  FROM raw_line_items
  QUALIFY ROW_NUMBER() OVER (PARTITION BY line_item_id, invoice_id
    ORDER BY product_name NULLS LAST, quantity NULLS LAST,
             CAST(unit_price AS DECIMAL(18,2)) NULLS LAST) = 1)
SELECT invoice_id, COUNT(line_item_id) AS line_item_count,
       CAST((SUM(quantity * billionths) + 500) // 1000 AS DOUBLE) / 1000000
         AS calculated_invoice_total
FROM lines GROUP BY invoice_id"""

_SKEWED = (
    _RAW.replace("raw_invoices AS", "plain_invoices AS").replace("raw_line_items AS", "plain_lines AS")
    + """,
raw_invoices AS (
  SELECT * REPLACE (CASE WHEN invoice_id % 3 = 0 THEN 7 ELSE customer_id END AS customer_id)
  FROM plain_invoices),
raw_line_items AS (
  SELECT CASE invoice_id % 3 WHEN 0 THEN invoice_id * 10 + line_item_id WHEN 1 THEN 1
              ELSE line_item_id END AS line_item_id,
         CASE invoice_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE invoice_id END AS invoice_id,
         CASE invoice_id % 3 WHEN 1 THEN 'copy' ELSE product_name END AS product_name,
         CASE invoice_id % 3 WHEN 1 THEN 2 ELSE quantity END AS quantity,
         CASE invoice_id % 3 WHEN 1 THEN '1.25' ELSE unit_price END AS unit_price
  FROM plain_lines)"""
)

_LAST_INVOICE = "(SELECT CAST(MAX(CAST(o_orderdate AS DATE)) AS TIMESTAMP) FROM orders)"

ORACLES: dict[str, str] = {
    "raw_csv_scan": _on(_RAW, "SELECT * FROM raw_invoices"),
    "raw_csv_scan_customers": _on(
        _RAW, "SELECT * REPLACE (NULLIF(country, '') AS country) FROM raw_customers"
    ),
    "raw_csv_scan_line_items": _on(_RAW, "SELECT * FROM raw_line_items"),
    "raw_csv_scan_line_breaks": _on(
        _RAW,
        """SELECT line_item_id, invoice_id, quantity, unit_price, CASE WHEN invoice_id % 3 = 0
        THEN replace(product_name, ' ', chr(10)) || chr(10) || '"new", as is' ELSE product_name END
        AS product_name FROM raw_line_items""",
    ),
    "raw_refresh_roundtrip": _on(_RAW, "SELECT * FROM raw_customers"),
    "load_manifest": _on(
        _RAW,
        "SELECT 'invoices' AS table_name, COUNT(*) AS row_count FROM raw_invoices UNION ALL "
        "SELECT 'customers', COUNT(*) FROM raw_customers UNION ALL "
        "SELECT 'invoice_line_items', COUNT(*) FROM raw_line_items",
    ),
    "stg_invoices": _on(_STAGED, "SELECT * FROM stg_invoices"),
    "stg_customers": _on(_STAGED, "SELECT * FROM stg_customers"),
    "stg_invoice_line_items": _on(_STAGED, "SELECT * FROM stg_invoice_line_items"),
    "normalise_text": _NORMALISED.strip(),
    "line_totals_detail": _on(
        _STAGED, "SELECT *, quantity * unit_price AS line_total FROM stg_invoice_line_items"
    ),
    "invoice_line_totals": _on(_LEDGER, "SELECT * FROM line_totals"),
    "invoice_line_totals_small_prices": f"WITH {_RAW.strip()},{_SMALL_PRICES}",
    "ledger_skewed": _on(f"{_SKEWED},{_STAGING},{_TOTALS}", "SELECT * FROM ledger"),
    "invoice_customer_enrich": _on(
        _STAGED,
        "SELECT i.*, c.* EXCLUDE (customer_id) FROM stg_invoices i "
        "LEFT JOIN stg_customers c ON i.customer_id = c.customer_id",
    ),
    "int_invoice_totals": _LEDGER_ROWS,
    "mart_invoice_ledger": _LEDGER_ROWS,
    "dq_unique": _on(
        _LEDGER,
        "\nUNION ALL ".join(
            [
                _repeated("raw.invoices", "invoice_id", "raw_invoices",
                          "CAST(invoice_id AS VARCHAR)"),
                _repeated("raw.customers", "customer_id", "raw_customers",
                          "CAST(customer_id AS VARCHAR)"),
                _repeated("raw.invoice_line_items", "invoice_id,line_item_id", "raw_line_items",
                          "invoice_id || ',' || line_item_id"),
                _repeated("mart_invoice_ledger", "invoice_id", "ledger",
                          "CAST(invoice_id AS VARCHAR)"),
            ]
        ),
    ),
    "dq_not_null": _row_wise("not_null"),
    "dq_expression_is_true": _row_wise("expression_is_true"),
    "dq_accepted_values": _on(
        _LEDGER,
        "\nUNION ALL ".join(
            [
                _outside("stg_invoices", "stg_invoices", "invoice_status", _STATUSES),
                _outside("stg_customers", "stg_customers", "customer_segment", _SEGMENTS),
                _outside("int_invoice_totals", "ledger", "customer_segment", _SEGMENTS),
                _outside("int_invoice_totals", "ledger", "invoice_status", _STATUSES),
                _outside("mart_invoice_ledger", "ledger", "invoice_status", _STATUSES),
            ]
        ),
    ),
    "dq_relationships": _on(
        _STAGED,
        "SELECT 'stg_invoice_line_items' AS child, 'stg_invoices' AS parent, "
        "invoice_id AS key_value, COUNT(*) AS child_rows FROM stg_invoice_line_items "
        "WHERE invoice_id NOT IN (SELECT invoice_id FROM stg_invoices) GROUP BY invoice_id "
        "UNION ALL SELECT 'stg_invoices', 'stg_customers', customer_id, COUNT(*) "
        "FROM stg_invoices WHERE customer_id NOT IN (SELECT customer_id FROM stg_customers) "
        "GROUP BY customer_id",
    ),
    "dq_invoice_without_customer": _on(
        _LEDGER, "SELECT invoice_id, customer_name FROM ledger WHERE customer_name IS NULL"
    ),
    "dq_amount_without_lines": _on(
        _LEDGER,
        "SELECT invoice_id, line_item_count, invoice_amount FROM ledger "
        "WHERE line_item_count = 0 AND invoice_amount <> 0.00",
    ),
    "dq_line_math": _on(
        _STAGED,
        "SELECT line_item_id, invoice_id, quantity * unit_price + 1 AS line_total "
        "FROM stg_invoice_line_items WHERE invoice_id % 13 = 0",
    ),
    "dq_total_reconcile": _on(
        _SPOILT,
        "SELECT s.invoice_id, s.calculated_invoice_total, "
        "COALESCE(t.calculated_invoice_total, 0.0) AS line_sum "
        "FROM spoilt s LEFT JOIN line_totals t ON s.invoice_id = t.invoice_id "
        "WHERE abs(s.calculated_invoice_total - COALESCE(t.calculated_invoice_total, 0.0)) "
        "> 0.000001",
    ),
    "dq_zero_line_zero_total": _on(
        _SPOILT,
        "SELECT invoice_id, line_item_count, calculated_invoice_total FROM spoilt "
        "WHERE line_item_count = 0 AND calculated_invoice_total <> 0",
    ),
    "dq_date_order": _on(
        _LEDGER,
        "SELECT invoice_id, invoice_date, invoice_due_date FROM ledger "
        "WHERE invoice_due_date < invoice_date",
    ),
    "dq_report": _on(_LEDGER, _report(_checks(_OWN_SEGMENTS) + _ADVISORY)),
    "dq_status_tally": _on(
        _LEDGER,
        "SELECT COUNT(*) FILTER (status = 'error') AS error_count, "
        "COUNT(*) FILTER (status = 'fail') AS failure_count, "
        "COUNT(*) FILTER (status = 'skipped') AS skip_count, "
        "COUNT(*) FILTER (status IN ('error', 'fail', 'skipped')) AS total_failures "
        f"FROM ({_report(_checks(_SEGMENTS) + _ADVISORY)})",
    ),
    "contract_schema_report": _schema_report(),
    "contract_constraints": _constraints(),
    "contract_rows_valid": _on(_SPOILT, f"SELECT * FROM spoilt WHERE {_VIOLATIONS} = ''"),
    "contract_rows_rejected": _on(
        _SPOILT,
        "SELECT * FROM (SELECT invoice_id, "
        f"{_VIOLATIONS} AS violations FROM spoilt) WHERE violations <> ''",
    ),
    "publish_then_read": _LEDGER_ROWS,
    "ledger_read_v1": _LEDGER_ROWS,
    "failed_publish_keeps_previous": _LEDGER_ROWS,
    "public_view_after_failed_build": _LEDGER_ROWS,
    "view_of_two_warehouses": _LEDGER_ROWS,
    "reset_slots": f"SELECT *, 'prod_blue' AS active_schema FROM ({_LEDGER_ROWS})",
    "recheck_stored_slot": _on(_LEDGER, _report(_checks(_OWN_SEGMENTS) + _ADVISORY)),
    "ledger_two_versions": _on(
        _LEDGER,
        "SELECT *, invoice_amount AS billed_amount, "
        "COALESCE(customer_name, '?') || ' / ' || COALESCE(customer_country, '?') AS customer_label, "
        f"invoice_status = 'overdue' AS is_overdue FROM ledger WHERE {_VIOLATIONS} = ''",
    ),
    "publish_gate": _gate(),
    "next_slot": (
        "SELECT CAST(NULL AS VARCHAR) AS active_schema, 'blue' AS next_target, 0 AS deployed "
        "UNION ALL SELECT 'prod_blue', 'green', 1 UNION ALL SELECT 'prod_green', 'blue', 2"
    ),
    "latest_deployment": (
        f"SELECT 'prod_green' AS active_schema, {_LAST_INVOICE} - INTERVAL 1 DAY AS deployed_at"
    ),
    "deployment_state": f"SELECT 'prod_blue' AS active_schema, {_LAST_INVOICE} AS deployed_at",
    "deployment_status": (
        "SELECT 'healthy' AS status, 'prod_blue' AS active_schema, "
        f"strftime({_LAST_INVOICE}, '%Y-%m-%d %H:%M:%S') AS deployed_at"
    ),
    "rebuild_is_idempotent": _on(
        _LEDGER,
        "SELECT COUNT(*) AS rows_first, COUNT(*) AS rows_second, CAST(0 AS BIGINT) AS only_first, "
        "CAST(0 AS BIGINT) AS only_second FROM ledger",
    ),
    "ledger_export_manifest": _on(
        _LEDGER, "SELECT COUNT(*) AS count, 'v1' AS version FROM ledger"
    ),
    "ledger_export_rows": _LEDGER_ROWS,
    "failed_export_keeps_previous": _LEDGER_ROWS,
    "ledger_display": _on(_LEDGER, _DISPLAY),
}
