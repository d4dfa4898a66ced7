"""Sums of amounts that neither lose small ones nor depend on the order of addition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 6
_ONE = 10**SCALE
#: Amounts from here on are added as DOUBLE: a double of that size steps by more than 10**4.
_LARGEST = 1e20
#: Amounts below this that have no more than ``SCALE`` decimals are whole numbers of millionths that
#: a DOUBLE holds: at most 15 digits, which are the ones it is written with.
_PLAIN = 1e9
#: Whole units are added in digits of this base.
_BASE = 10**9


def _div(a: Column, b: int) -> Column:
    """Whole division towards zero; ``%`` gives the rest that belongs to it."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def exact_sum(amount: Column, times: Column | None = None) -> Column:
    """Sum of ``amount``, or of ``times`` (whole numbers of 32 bits) its value, rounded once to a millionth.

    A DOUBLE counts as the decimal number it is written as, to 18 places, and nothing is rounded
    before the end, when half a millionth is rounded up; a retried task or another partitioning
    changes nothing. Amounts of up to six decimals, nearly all, are added as whole numbers: billions,
    units and millionths apart, each in a BIGINT that three billion rows of one group cannot overflow.
    Only others go through decimals. Infinite and NaN amounts and those beyond 10**20 keep the
    meaning they have as DOUBLE, and so do totals beyond 10**31. The sum is NULL when every amount is.
    """
    times = (F.lit(1) if times is None else times).cast("bigint")
    scaled = F.rint(amount * _ONE)
    plain = (F.abs(amount) < _PLAIN) & (scaled / _ONE == amount)
    whole = F.when(plain, scaled.cast("bigint"))
    units, rest = _div(whole, _ONE) * times, whole % _ONE * times
    billions = F.sum(_div(units, _BASE))
    ones = F.sum(units % _BASE + _div(rest, _ONE))
    millionths = F.sum(rest % _ONE)

    other = F.when(~plain & (F.abs(amount) < _LARGEST), amount).cast("decimal(38,18)")
    floor = F.floor(other).cast("decimal(21,0)")
    count = times.cast("decimal(10,0)")
    floors = F.sum(count * floor)
    fractions = F.sum(count * (other - floor).cast("decimal(19,18)"))

    # Carry the millionths, so that each part has the digits its type says.
    ones += _div(millionths, _ONE)
    billions += _div(ones, _BASE)
    below = ones % _BASE * _ONE + millionths % _ONE
    # Below nine billion a DOUBLE holds the millionths, and dividing them is rounding once.
    light = floors.isNull() & (F.abs(billions) < 9)
    quick = (billions * (_BASE * _ONE) + below).cast("double") / _ONE

    none = F.lit(0).cast("decimal(38,18)")
    large = billions.cast("decimal(19,0)") * F.lit(_BASE).cast("decimal(10,0)")
    large = F.coalesce(large.cast("decimal(38,0)"), none.cast("decimal(38,0)"))
    large = F.try_add(large, F.coalesce(floors.cast("decimal(38,0)"), none.cast("decimal(38,0)")))
    small = below.cast("decimal(19,0)") * F.lit("0.000001").cast("decimal(6,6)")
    small = F.coalesce(small.cast("decimal(38,18)"), none) + F.coalesce(fractions, none)
    # Decimals of these types are added in full and rounded to the scale that is left, six places.
    total = F.round(large.try_cast("decimal(31,0)") + small.cast("decimal(38,18)"), SCALE)
    wide = large.cast("double") + small.cast("double")
    some = floors.isNotNull() | billions.isNotNull()
    exact = F.when(light, quick).when(some, F.coalesce(total.cast("double"), wide))

    extreme = F.sum(F.when(F.abs(amount) >= _LARGEST, amount * times))
    return F.when(extreme.isNull(), exact).otherwise(extreme + F.coalesce(exact, F.lit(0.0)))


def difference(a: Column, b: Column) -> Column:
    return F.round(a - b, SCALE)
