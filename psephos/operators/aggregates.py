"""Aggregates that Spark has no single function for; all keep partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.functions.nulls import col, collapse_text, finite
from psephos.functions.text import GENERIC_LABELS

#: A sum of weights not larger than this is no weight.
TINY = 1e-12


def wmean(value: Column | str, weight: Column | str) -> Column:
    """Weighted mean over rows where both are finite; NULL if their weights sum to nothing."""
    ok = finite(value) & finite(weight)
    total = F.sum(F.when(ok, col(weight)))
    return F.when(F.abs(total) > TINY, F.sum(F.when(ok, col(value) * col(weight))) / total)


def total(value: Column | str) -> Column:
    """Sum, 0 where there is nothing to sum."""
    return F.coalesce(F.sum(col(value)), F.lit(0.0))


def first_known(value: Column | str, order: Column | str) -> Column:
    """The first value that is not missing, in the order of ``order``."""
    v = col(value)
    return F.min_by(v, F.when(v.isNotNull(), col(order)))


def first_nonempty(value: Column | str, order: Column | str) -> Column:
    v = collapse_text(value)
    return F.coalesce(F.min_by(v, F.when(v != "", col(order))), F.lit(""))


def canonical_name(value: Column | str) -> Column:
    """Among the distinct names the one that is not generic, longest, first in lower case; empty if there is none."""
    v = collapse_text(value)
    key = F.struct(F.lower(v).isin(*GENERIC_LABELS), -F.length(v), F.lower(v), v)
    return F.coalesce(F.min_by(v, F.when(v != "", key)), F.lit(""))


def alias_list(value: Column | str) -> Column:
    """The distinct non-empty names, sorted, joined by double bars (distinct names of one entity are few)."""
    v = collapse_text(value)
    return F.array_join(F.array_sort(F.collect_set(F.when(v != "", v))), " || ")


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def latest_mode(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the most frequent value, the largest of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("count", value)).alias(name))


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key, the first by ``order``; unlike dropDuplicates it is told which."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is not missing and occurs once."""
    once = df.dropna(subset=keys).groupBy(*keys).count().where("count = 1").drop("count")
    return df.join(once, keys, "left_semi")


def checks(df: DataFrame, measures: list[tuple[str, Column]]) -> DataFrame:
    """One pass over ``df`` as tidy (metric, value) rows."""
    wide = df.agg(*(c.cast("double").alias(n) for n, c in measures))
    return wide.selectExpr(f"stack({len(measures)}, {', '.join(f'{chr(39)}{n}{chr(39)}, `{n}`' for n, _ in measures)}) AS (metric, value)")
