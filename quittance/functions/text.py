"""Text and number normalisation as Column expressions.

The rules are those of a warehouse that trims every Unicode space and maps case one character
to one. Spark trims U+0020 only and maps case by the full Unicode rules, so the non-ASCII
branch prepares the text first; ASCII text takes Spark's own fast functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode space separators (general category Zs).
SPACES = (
    "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)

# Characters whose full upper-case form is several characters. Each is parked on a
# private-use character while the rest is upper-cased, then replaced by its one-character form.
_EXPANDING = [chr(c) for c in range(0x80, 0x10000) if len(chr(c).upper()) > 1]
_PARKED = [chr(0x10F000 + i) for i in range(len(_EXPANDING))]
_SINGLE = [
    "ẞ" if c == "ß" else (c.title() if len(c.title()) == 1 else c) for c in _EXPANDING
]


def _is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def strip(c: Column) -> Column:
    """Remove Unicode spaces at both ends; tabs and newlines stay."""
    return F.when(_is_ascii(c), F.trim(c)).otherwise(F.btrim(c, F.lit(SPACES)))


def lower(c: Column) -> Column:
    """Lower case, one character to one character and regardless of position."""
    return F.when(_is_ascii(c), F.lower(c)).otherwise(
        F.lower(F.translate(c, "İΣ", "iσ"))
    )


def upper(c: Column) -> Column:
    """Upper case, one character to one character."""
    expanding, parked, single = "".join(_EXPANDING), "".join(_PARKED), "".join(_SINGLE)
    return F.when(_is_ascii(c), F.upper(c)).otherwise(
        F.translate(F.upper(F.translate(c, expanding, parked)), parked, single)
    )


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_unknown(c: Column) -> Column:
    """NULL becomes 'unknown'; a blank stays blank and is left for the checks to flag."""
    return F.coalesce(c, F.lit("unknown"))


def to_double(c: Column) -> Column:
    """Text to DOUBLE. Text that is no number fails the job instead of becoming NULL.

    Underscores between digits are accepted; what Spark takes beyond that, ``1.5d``, ``1.5f`` and
    hexadecimal floats such as ``0x1p3``, is not.
    """
    digits = F.when(
        F.contains(c, F.lit("_")), F.regexp_replace(c, r"(?<=[0-9])_(?=[0-9])", "")
    ).otherwise(c)
    complain = F.raise_error(F.concat(F.lit("not a number: "), c))
    return F.when(c.rlike(r"[0-9.][dDfF]\s*$|[xX]"), complain).otherwise(
        F.coalesce(digits.try_cast("double"), F.when(c.isNotNull(), complain))
    )
