"""Rounding, bands and checks of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from psephos.functions.nulls import col, if_finite

#: Codes of the detailed education variable and the level each stands for; fixed values.
EDUCATION_LEVELS = {
    1: (0, 113),
    2: (129, 212, 213, 221, 222, 223),
    3: (229, 311, 312, 313, 321, 322, 323),
    4: (412, 413, 421, 422, 423),
    5: (510, 520, 610, 620, 710, 720, 800),
    55: (5555,),
}


def round_int(x: Column | str) -> Column:
    """Nearest integer, halves to even."""
    return F.rint(col(x)).cast("bigint")


def round_share(x: Column | str, digits: int = 3) -> Column:
    return F.round(if_finite(x), digits)


def education_level(detailed: Column | str) -> Column:
    out = F.lit(None).cast("double")
    for level, codes in EDUCATION_LEVELS.items():
        out = F.when(col(detailed).isin(*codes), float(level)).otherwise(out)
    return out


def education_category(short: Column | str, detailed: Column | str) -> Column:
    """Three categories from the short variable, else from the detailed one."""
    level = F.coalesce(col(short).cast("double"), education_level(detailed))
    return F.when(level.isin(1.0, 2.0), 1.0).when(level.isin(3.0, 4.0), 2.0).when(level == 5, 3.0)


def p_value(t: Column | str) -> Column:
    """Two-sided normal p-value by a rational approximation of the error function (absolute error below 1.5e-7)."""
    x = F.abs(col(t)) / F.sqrt(F.lit(2.0))
    k = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k
    return F.when(col(t).isNotNull(), poly * F.exp(-x * x))


def stars(p: Column | str) -> Column:
    c = if_finite(p)
    return F.when(c < 0.01, "***").when(c < 0.05, "**").when(c < 0.1, "*").otherwise("")


def gap_band(gap: Column | str) -> Column:
    g = col(gap)
    return F.when(g.isNull(), "").when(g <= 2, "within_2pp").when(g <= 5, "within_5pp").when(g <= 10, "within_10pp").otherwise("over_10pp")


def gap_alert(gap: Column | str) -> Column:
    g = col(gap)
    return F.when(g > 10, "very_large_gap_check").when(g > 5, "large_gap_review").otherwise("")


def gap_note(resolved: Column, survey: Column | str, official: Column | str, band: Column | str) -> Column:
    """'ESS a% vs MPD b% (+c pp; band)' for resolved rows with both shares."""
    a, b = col(survey), col(official)
    text = F.format_string("ESS %.2f%% vs MPD %.2f%% (%s%.2f pp%s)", a, b, F.when(a > b, "+").otherwise(""), a - b, F.when(col(band) != "", F.concat(F.lit("; "), col(band))).otherwise(""))
    return F.when(resolved & a.isNotNull() & b.isNotNull(), text).otherwise("")


def age_check(old: Column | str, new: Column | str) -> Column:
    o, n = col(old), col(new)
    gap = F.abs(o - n)
    return (
        F.when(o.isNull() & n.isNull(), "both_missing").when(o.isNull(), "old_missing").when(n.isNull(), "ai_missing")
        .when(gap < 1e-9, "exact_match").when(F.abs(gap - 1) < 1e-9, "off_by_one").otherwise("mismatch")
    )


def gender_check(old: Column | str, new: Column | str) -> Column:
    o, n = col(old), col(new)
    return (
        F.when(o.isNull() & n.isNull(), "both_missing").when(o.isNull(), "old_missing").when(n.isNull(), "ai_missing")
        .when(F.abs(o - n) < 1e-9, "match").otherwise("mismatch")
    )


def age_source(age: Column | str, born: Column | str, year: Column | str) -> Column:
    """How an age and a birth year agree."""
    a, b, y = col(age), col(born), col(year)
    gap = F.abs(a - (y - b))
    return (
        F.when(a.isNotNull() & b.isNotNull() & y.isNull(), "both_present_no_check").when(gap < 1e-9, "both_consistent")
        .when(F.abs(gap - 1) < 1e-9, "both_off_by_one").when(gap.isNotNull(), "both_inconsistent")
        .when(a.isNotNull(), "age_field_only").when(b.isNotNull(), "yearborn_only").otherwise("missing")
    )
