"""Every registered query against its SQL counterpart, on the smallest data set."""

from __future__ import annotations

import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from quittance.oracle import ORACLES
from quittance.operators.spread import find_hot_keys
from quittance.queries import QUERIES
from quittance.sources import testbed

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test data")

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as con:
        for f in SF_DIR.glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        yield con


def _comparable(rows):
    def plain(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)

    return sorted(tuple(plain(v) for v in row) for row in rows)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= entry_points.queries().items()
    assert ORACLES.items() <= entry_points.oracle_sql().items()


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1500


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, str(SF_DIR))
    columns = sorted(df.columns)
    result = duck.execute(f"SELECT {', '.join(columns)} FROM ({entry_points.oracle_sql()[name]})")
    types = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert _comparable(df.select(columns).collect()) == _comparable(result.fetchall())


def test_the_oracle_stands_alone():
    """Nothing of the code under test goes into the SQL it is checked by."""
    source = (Path(__file__).resolve().parent.parent / "quittance" / "oracle.py").read_text()
    assert not re.search(r"^\s*(from|import) quittance", source, re.MULTILINE)


def test_the_skewed_ledger_takes_the_spread_path(spark):
    raw = testbed.skewed(testbed.read_sources(spark, str(SF_DIR)))
    lines = find_hot_keys(raw["invoice_line_items"], "invoice_id", width=16)
    customers = find_hot_keys(raw["invoices"], "customer_id", width=16)
    assert {k for k, _ in lines.parts} == {1, 3} and {k for k, _ in customers.parts} == {7}
