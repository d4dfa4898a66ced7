"""Billing extracts derived from the benchmark tables, with realistic dirt worked in.

Orders become invoices, lineitem becomes invoice lines. Duplicates, orphans, blanks, odd case
and missing values are placed by arithmetic on the keys, so any engine sees the same input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.schemas import RAW_DDL

# The market segments of the benchmark customers, normalised.
SEGMENTS = ["automobile", "building", "furniture", "household", "machinery", "unknown"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money_text(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def _every(key: str, n: int) -> Column:
    return F.col(key) % n == 0


def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    issued = F.col("o_orderdate").cast("date")
    terms = F.when(_every("o_orderkey", 101), -2).otherwise(
        10 * F.substring("o_orderpriority", 1, 1).cast("int")
    )
    status = (
        F.when(_every("o_orderkey", 50), None)
        .when(F.col("o_orderstatus") == "F", " PAID ")
        .when(F.col("o_orderstatus") == "O", "Pending")
        .otherwise("overdue")
    )
    copies = F.when(F.col("o_orderkey") % 10 == 3, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return (
        _table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderkey").alias("invoice_id"),
            F.when(_every("o_orderkey", 97), -F.col("o_custkey") - 1)
            .otherwise(F.col("o_custkey"))
            .alias("customer_id"),
            _money_text("o_totalprice").alias("amount"),
            status.alias("status"),
            issued.alias("invoice_date"),
            F.date_add(issued, terms).alias("due_date"),
            F.explode(copies).alias("_copy"),
        )
        .drop("_copy")
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name"
    )
    name = F.when(_every("c_custkey", 40), "  ").otherwise(
        F.concat(F.lit(" "), "c_name", F.lit(" "))
    )
    return (
        _table(spark, sf_dir, "customer")
        .join(nation, "c_nationkey")
        .select(
            F.col("c_custkey").alias("customer_id"),
            name.alias("customer_name"),
            F.when(_every("c_custkey", 33), "").otherwise(F.lower("n_name")).alias("country"),
            F.when(_every("c_custkey", 21), None).otherwise(F.col("c_mktsegment")).alias("segment"),
            F.when(_every("c_custkey", 17), None)
            .otherwise(F.concat("c_name", F.lit("@Example.com")))
            .alias("email"),
        )
    )


def _invoice_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_name").alias("product_name"),
        _money_text("p_retailprice").alias("unit_price"),
    )
    # Plain scans meet here, so AQE itself splits the partition of a part that is sold very often.
    return (
        _table(spark, sf_dir, "lineitem")
        .join(part, "l_partkey")
        .select(
            F.col("l_linenumber").cast("bigint").alias("line_item_id"),
            F.col("l_orderkey").alias("invoice_id"),
            "product_name",
            F.col("l_quantity").cast("int").alias("quantity"),
            "unit_price",
        )
    )


_ADAPTERS = {
    "invoices": _invoices,
    "customers": _customers,
    "invoice_line_items": _invoice_line_items,
}


def read_source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One raw table, by the name it has in the raw schema."""
    return _ADAPTERS[table](spark, sf_dir)


def read_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {table: read_source(spark, sf_dir, table) for table in RAW_DDL}


def line_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoice ids of the raw lines, without the join the full lines need."""
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_id"))


def invoice_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer ids of the raw invoices, orphans and copies aside."""
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id"))


def messy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer text with wide spaces, line breaks and letters whose case mapping is irregular."""
    key = F.col("c_custkey")
    wrap = (
        F.when(key % 5 == 0, F.concat(F.lit("\u00a0\u3000"), "c_name", F.lit(" \u2003")))
        .when(key % 5 == 1, F.concat(F.lit("\t"), "c_name", F.lit("\n ")))
        .when(key % 5 == 2, F.lit(" \u00a0 "))
        .when(key % 5 == 3, F.lit(None).cast("string"))
        .otherwise(F.col("c_name"))
    )
    letters = F.when(key % 3 == 0, F.concat(F.lit(" Straße ﬁ "), "c_mktsegment")).when(
        key % 3 == 1, F.concat(F.lit(" İzmir ΟΔΟΣ "), "c_mktsegment")
    )
    return _table(spark, sf_dir, "customer").select(
        key.alias("customer_id"), wrap.alias("padded"), letters.alias("letters")
    )


def spoil_ledger(ledger: DataFrame) -> DataFrame:
    """Ledger rows with one kind of contract breach planted on every so many invoices."""
    key = "invoice_id"
    spoilt = {
        "invoice_amount": F.when(_every(key, 31), -F.col("invoice_amount") - 1)
        .when(_every(key, 59), F.lit(float("nan")))
        .otherwise(F.col("invoice_amount")),
        "invoice_status": F.when(_every(key, 37), "deleted").otherwise(F.col("invoice_status")),
        "line_item_count": F.when(_every(key, 41), -1)
        .otherwise(F.col("line_item_count"))
        .cast("bigint"),
        "calculated_invoice_total": F.when(_every(key, 43), -50.0)
        .when(_every(key, 29), F.col("calculated_invoice_total") + 1)
        .otherwise(F.col("calculated_invoice_total")),
        "invoice_date": F.when(_every(key, 47), None).otherwise(F.col("invoice_date")),
        "payment_terms_days": F.when(_every(key, 53), None).otherwise(F.col("payment_terms_days")),
    }
    return ledger.withColumns(spoilt)


def skewed(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The raw tables with hot keys.

    A third of the invoices belong to one customer. Of the lines, a third lie on one invoice and
    another third are copies of one line.
    """
    owner, line = F.col("invoice_id"), raw["invoice_line_items"]
    on_one, copy = owner % 3 == 0, owner % 3 == 1

    def where_hot(hot, copied, column):
        return F.when(on_one, hot).when(copy, copied).otherwise(F.col(column))

    return {
        "invoices": raw["invoices"].withColumn(
            "customer_id", F.when(on_one, F.lit(7)).otherwise(F.col("customer_id"))
        ),
        "customers": raw["customers"],
        "invoice_line_items": line.select(
            where_hot(owner * 10 + F.col("line_item_id"), F.lit(1), "line_item_id").alias("line_item_id"),
            where_hot(F.lit(3), F.lit(1), "invoice_id").cast("bigint").alias("invoice_id"),
            F.when(copy, "copy").otherwise(F.col("product_name")).alias("product_name"),
            F.when(copy, 2).otherwise(F.col("quantity")).alias("quantity"),
            F.when(copy, "1.25").otherwise(F.col("unit_price")).alias("unit_price"),
        ),
    }


def wrapped(lines: DataFrame) -> DataFrame:
    """Raw lines, every third invoice's with a word of the product name per line and a quoted mark."""
    one_a_line = F.concat(F.replace("product_name", F.lit(" "), F.lit("\n")), F.lit('\n"new", as is'))
    return lines.withColumn(
        "product_name", F.when(_every("invoice_id", 3), one_a_line).otherwise(F.col("product_name"))
    )


def metered(lines: DataFrame) -> DataFrame:
    """Raw lines whose prices are ten million times smaller: far below a millionth a piece."""
    small = F.col("unit_price").cast("decimal(18,2)") / F.lit(10_000_000).cast("decimal(8,0)")
    return lines.withColumn("unit_price", small.cast("decimal(20,9)").cast("string"))


def spoil_lines(line_totals: DataFrame) -> DataFrame:
    """Per-line totals, some of them off by one."""
    return line_totals.withColumn(
        "line_total",
        F.when(_every("invoice_id", 13), F.col("line_total") + 1).otherwise(F.col("line_total")),
    )


def spoil_invoices(invoices: DataFrame) -> DataFrame:
    """Raw invoices, some of them with a negative amount."""
    return invoices.withColumn(
        "amount",
        F.when(_every("invoice_id", 61), F.concat(F.lit("-"), "amount")).otherwise(F.col("amount")),
    )
