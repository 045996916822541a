"""Missing values and tolerant casts.

Missing numbers are NULL inside the engine: NaN and unparsable text become NULL at the door, so that joins, groups and
aggregates follow SQL rules and nothing has to test for two kinds of missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing value, in lower case; fixed values.
MISSING_TEXTS = ("", "nan", "none", "<na>")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_nan(x: Column | str) -> Column:
    """NaN as NULL (for doubles)."""
    return F.nanvl(col(x), F.lit(None).cast("double"))


def to_num(x: Column | str) -> Column:
    """Double, or NULL where that cannot be: like a coercing parse, a trailing type letter ('1d') is not a number."""
    text = F.trim(col(x).cast("string"))
    return F.when(~text.rlike("[dDfFlL]$") | text.rlike("(?i)inf$"), null_nan(text.try_cast("double")))


def finite(x: Column | str) -> Column:
    """True for numbers that are neither missing nor infinite; never NULL."""
    c = col(x)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def if_finite(x: Column | str) -> Column:
    return F.when(finite(x), col(x))


def truthy(cond: Column) -> Column:
    """A condition whose unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def collapse_text(x: Column | str) -> Column:
    """Text without missing values: no-break spaces as spaces, runs of white space as one, none at the ends."""
    text = F.regexp_replace(F.replace(F.coalesce(col(x), F.lit("")), F.lit("\u00a0"), F.lit(" ")), r"(?U)\s+", " ")
    return F.trim(text)


def clean_text(x: Column | str) -> Column:
    """Trimmed text; words that stand for missing become empty."""
    text = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.lower(text).isin(*MISSING_TEXTS), F.lit("")).otherwise(text)


def first_text(*xs: Column | str) -> Column:
    """The first text that is not empty, else the empty text."""
    return F.coalesce(*(F.nullif(clean_text(x), F.lit("")) for x in xs), F.lit(""))


def first_number(*xs: Column | str) -> Column:
    return F.coalesce(*(to_num(x) for x in xs))


def complete(df: DataFrame, names: list[str]) -> Column:
    """All of ``names`` present and not NULL; false if a column is missing, true for no names."""
    if any(n not in df.columns for n in names):
        return F.lit(False)
    return reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names), F.lit(True))
