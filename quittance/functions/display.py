"""Presentation formats of the ledger table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def currency(amount: Column) -> Column:
    """US dollars, e.g. ``$1,850.00`` and ``-$25.50``."""
    sign = F.when(amount < 0, F.lit("-$")).otherwise(F.lit("$"))
    return F.concat(sign, F.format_number(F.abs(F.round(amount, 2)), 2))


def short_date(day: Column) -> Column:
    """E.g. ``Jan 5, 2024``."""
    return F.date_format(day, "MMM d, yyyy")


def or_dash(c: Column) -> Column:
    return F.coalesce(c, F.lit("—"))
