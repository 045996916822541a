"""Dates that may be missing or malformed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from psephos.functions.nulls import col


def parse_date(x: Column | str) -> Column:
    """An ISO date, or NULL."""
    return F.try_to_date(F.trim(col(x).cast("string")), "yyyy-MM-dd")


def parse_day_first(x: Column | str) -> Column:
    """Day first with slashes, dots or dashes; also '24nov2002'."""
    text = F.trim(col(x).cast("string"))
    plain = F.regexp_replace(text, r"[.\-]", "/")
    named = F.concat(F.regexp_extract(text, r"^(\d{1,2})[a-zA-Z]{3}\d{4}$", 1), F.initcap(F.regexp_extract(text, r"^\d{1,2}([a-zA-Z]{3})\d{4}$", 1)), F.regexp_extract(text, r"^\d{1,2}[a-zA-Z]{3}(\d{4})$", 1))
    return F.coalesce(F.try_to_date(plain, "d/M/yyyy"), F.try_to_date(F.nullif(named, F.lit("")), "dMMMyyyy"))


def from_parts(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """A date of its parts, NULL if they are none; a missing day is the 15th."""
    y, m, d = col(year), col(month), F.coalesce(col(day), F.lit(15))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd")


def years_between(born: Column | str, day: Column | str) -> Column:
    """Completed years."""
    b, d = col(born), col(day)
    early = (F.month(d) < F.month(b)) | ((F.month(d) == F.month(b)) & (F.dayofmonth(d) < F.dayofmonth(b)))
    return (F.year(d) - F.year(b) - early.cast("int")).cast("double")


def age_on(day: Column | str, born_iso: Column | str, born_year: Column | str) -> Column:
    """struct(age, method): by the birth date if there is one, else by the year, else NULLs."""
    d, born, year = col(day), parse_date(born_iso), col(born_year)
    by_date = d.isNotNull() & born.isNotNull()
    by_year = d.isNotNull() & year.isNotNull()
    age = F.when(by_date, years_between(born, d)).when(by_year, (F.year(d) - year.cast("int")).cast("double"))
    return F.struct(age.alias("age"), F.when(by_date, "exact_date").when(by_year, "birth_year_only").alias("method"))


def year_of_month_code(x: Column | str) -> Column:
    """The year of YYYYMM."""
    return F.floor(col(x) / 100).cast("bigint")


def iso_text(x: Column | str) -> Column:
    """YYYY-MM-DD, empty where missing."""
    return F.coalesce(F.date_format(col(x), "yyyy-MM-dd"), F.lit(""))
