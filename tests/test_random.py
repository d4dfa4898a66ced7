"""The whole model chain on random dirty tables, against SQL on the same rows."""

from __future__ import annotations

import random
from datetime import date, timedelta

import duckdb
import pytest

from quittance.operators.spread import HotKeys, find_hot_keys
from quittance.oracle import LEDGER_FROM_RAW
from quittance.plans import marts, quality, staging
from quittance.schemas import MART_V1, raw_schema

TEXTS = [None, "", " ", "  ", "paid", " PAID", "Paid ", "über Straße", " İş　", "ΣΑΣ", "a\tb"]
HOT = HotKeys(parts=((3, 5), (4, 2), (900, 3)), null_parts=4)


def _tables(seed):
    rng = random.Random(seed)

    def money():
        cents = f"{rng.randint(0, 99999) / 100:.2f}"
        return rng.choice([None, "0", cents, f" {rng.randint(1, 9)}e2 "])

    def day():
        return rng.choice([None, date(2024, 1, 1) + timedelta(days=rng.randint(0, 400))])

    def key(n):
        # A third of the rows share one key, some have none.
        return rng.choice([None, 3, 3, 3, 3, *[rng.randint(1, n) for _ in range(7)]])

    invoices = [
        (key(150), key(30), money(), rng.choice(TEXTS), day(), day()) for _ in range(400)
    ]
    customers = [(key(25), *rng.choices(TEXTS, k=4)) for _ in range(80)]
    lines = [
        (
            key(6),
            key(170),
            rng.choice(TEXTS),
            rng.choice([None, *range(12)]),
            rng.choice([None, "0.10", "19.99", "1250", "0.333333"]),
        )
        for _ in range(1500)
    ]
    return {"invoices": invoices, "customers": customers, "invoice_line_items": lines}


def _duck_ledger(tables):
    names = {"invoice_line_items": "raw_line_items"}
    types = {"int": "INTEGER", "string": "VARCHAR", "date": "DATE"}
    with duckdb.connect() as con:
        for table, rows in tables.items():
            fields = raw_schema(table).fields
            name = names.get(table, f"raw_{table}")
            ddl = ", ".join(f"{f.name} {types[f.dataType.simpleString()]}" for f in fields)
            con.execute(f"CREATE TABLE {name} ({ddl})")
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(fields))})", rows)
        return con.execute(
            f"SELECT {', '.join(MART_V1.read_order)} FROM ({LEDGER_FROM_RAW})"
        ).fetchall()


@pytest.mark.parametrize("seed", range(4))
def test_ledger_equals_sql(spark, seed):
    tables = _tables(seed)
    raw = {
        t: spark.createDataFrame(rows, raw_schema(t)).repartition(5) for t, rows in tables.items()
    }
    want = sorted(map(repr, _duck_ledger(tables)))
    for hot in (HotKeys(), HOT):
        staged = staging.stage(raw, hot)
        totals = marts.int_invoice_totals(*(staged[m] for m in quality.STAGING_MODELS), hot)
        got = totals.select(*MART_V1.read_order).collect()
        assert sorted(repr(tuple(r)) for r in got) == want


@pytest.mark.parametrize("partitions", ["1", "8", "31"])
def test_ledger_does_not_depend_on_partitioning(spark, partitions):
    """Also with the hot keys found in the data, of which wide shuffles have some."""
    tables = _tables(99)
    raw = {
        t: spark.createDataFrame(rows, raw_schema(t)).repartition(int(partitions))
        for t, rows in tables.items()
    }
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        hot_invoices = find_hot_keys(raw["invoice_line_items"], "invoice_id")
        hot_customers = find_hot_keys(raw["invoices"], "customer_id")
        assert bool(hot_invoices) == bool(hot_customers) == (partitions != "1")
        staged = staging.stage(raw, hot_invoices)
        tables_in_order = [staged[m] for m in quality.STAGING_MODELS]
        totals = marts.int_invoice_totals(*tables_in_order, hot_customers)
        got = totals.select(*MART_V1.read_order).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, _duck_ledger(tables)))
