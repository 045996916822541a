"""Group-relative columns: shares, leave-one-out means, lags, standard scores and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.functions.nulls import col, finite, if_finite
from psephos.operators.aggregates import TINY


def group_total(value: Column | str, keys: list[str]) -> Column:
    """Sum over the group; NULL for rows with a missing key, which belong to no group."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return F.when(known, F.coalesce(F.sum(col(value)).over(Window.partitionBy(*keys)), F.lit(0.0)))


def share(weight: str, market: list[str], member: str) -> Column:
    """Share of the member's weight in the market's; rows without a member count in the denominator only."""
    return F.try_divide(group_total(weight, [*market, member]), group_total(weight, market))


def rescaled(share_col: str, market: list[str], most: float = 0.99) -> Column:
    """Shares of a market that leave nothing outside are scaled to sum to ``most``."""
    whole = F.sum(F.col(share_col)).over(Window.partitionBy(*market))
    return F.when(whole >= 1 - TINY, F.col(share_col) * most / whole).otherwise(F.col(share_col))


def leave_one_out(value: str, keys: list[str]) -> Column:
    """Mean of the group's other known values; NULL where there are none."""
    w = Window.partitionBy(*keys)
    n = F.count(value).over(w)
    return F.when((n > 1) & F.col(value).isNotNull(), (F.sum(value).over(w) - F.col(value)) / (n - 1))


def previous(value: str, key: str, order: list[Column | str]) -> Column:
    """The value of the key's previous row; NULL for rows without a key."""
    return F.when(F.col(key).isNotNull(), F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def ever_reaches(value: str, keys: list[str], threshold: float | None) -> Column:
    """Whether the group's largest value reaches the threshold (always, without one)."""
    if threshold is None:
        return F.lit(True)
    return F.coalesce(F.max(value).over(Window.partitionBy(*keys)) >= threshold, F.lit(False))


def demeaned(value: str, key: str) -> Column:
    return F.col(value) - F.when(F.col(key).isNotNull(), F.avg(value).over(Window.partitionBy(key)))


def score_params(df: DataFrame, value: str) -> DataFrame:
    """One row (mu, sd): mean and population standard deviation of the finite values."""
    return df.agg(F.avg(if_finite(value)).alias("mu"), F.stddev_pop(if_finite(value)).alias("sd"))


def standardised(df: DataFrame, value: str, name: str, params: DataFrame | None = None) -> DataFrame:
    """Standard scores by the column's own or given parameters; NULL where there is no spread."""
    row = score_params(df, value) if params is None else params
    z = F.when(finite(value) & (F.col("sd") > TINY), (F.col(value) - F.col("mu")) / F.col("sd"))
    return df.crossJoin(F.broadcast(row)).withColumn(name, z).drop("mu", "sd")  # a single row


#: Bounds of the ranges that rows are numbered in, at most, and how many of these are compared first.
RANGES, FEW = 1024, 32


def ranged(df: DataFrame, keys: list[Column | str], name: str) -> DataFrame:
    """The rows with the number of the range of ``keys`` (all ascending, missing values first) that they lie in.

    The bounds are whole keys, those with the least hashes: a sample that each task takes of its own rows and that is the same
    wherever rows lie. They are one row beside the table; a row compares its key with a few of them and then with those between.
    """
    key = F.struct(*(col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    sample = df.select(key.alias("_key")).orderBy(F.xxhash64("_key"), "_key").limit(RANGES)
    bounds = sample.agg(F.array_sort(F.collect_set("_key")).alias("_all"))
    step = F.greatest(F.ceil(F.size("_all") / FEW).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), F.lit(FEW - 1)), lambda k: F.slice("_all", k * F.col("_step") + 1, F.col("_step")))
    bounds = bounds.withColumn("_step", step).select("_step", F.filter(cut, lambda part: F.size(part) > 0).alias("_fine"))
    rows = df.withColumn("_key", key).crossJoin(F.broadcast(bounds.withColumn("_coarse", F.transform("_fine", lambda part: F.get(part, F.lit(0))))))  # a single row
    rows = rows.withColumn("_c", F.size(F.filter("_coarse", lambda b: b <= F.col("_key"))))
    near = F.size(F.filter(F.get("_fine", F.col("_c") - 1), lambda b: b <= F.col("_key")))
    place = F.when(F.col("_c") > 0, (F.col("_c") - 1) * F.col("_step") + near).otherwise(0)
    return rows.withColumn(name, place).drop("_key", "_step", "_fine", "_coarse", "_c")


def row_numbers(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of the given columns or expressions, all ascending, missing values first.

    Rows are numbered within ranges of the whole sort key, and each range begins where the counts of those before it end, so
    that no task has all rows, however few values the first column has.
    """
    rows = ranged(df, order, "_range")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn(name, own).join(F.broadcast(starts), "_range").withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_start")  # RANGES + 1 rows at most


def with_rank_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Dense ids, from 0, of the sorted distinct keys; only the distinct keys are ranked."""
    ids = row_numbers(df.select(key).dropna().distinct(), [key], name).withColumn(name, F.col(name) - 1)
    return df.join(ids, key, "left")


def numbered(df: DataFrame, order: list[Column | str], name: str, pattern: str) -> DataFrame:
    """Formatted consecutive ids in a given order."""
    return row_numbers(df, order, name).withColumn(name, F.format_string(pattern, name))


def first_seen_codes(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Codes from 0 in order of first appearance; NULL keys have -1."""
    seen = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    codes = row_numbers(seen, ["_first"], name).select(key, (F.col(name) - 1).alias(name))
    return df.join(codes, key, "left").withColumn(name, F.coalesce(name, F.lit(-1)))
