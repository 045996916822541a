"""Weighted resampling with replacement, a fixed number of draws for each market."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import IntegralType

from psephos.functions.nulls import finite
from psephos.operators.similarity import once

#: Parts that a market's rows are dealt to, so that a market of any size is spread over many tasks.
PARTS = 64
#: Ranges of the order that a part is cut into; rows are sorted only in those that a draw falls into.
RANGES = 64


def _held(rows: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """For each pick (keys, _at, agent_ids) the ``_row`` of the first row (keys, _at, _row) of its group that lies at or after
    it, else of the last one; one sorted pass over both together, no pair of them is formed."""
    both = rows.select(*keys, "_at", "_row", F.lit(None).cast("int").alias("agent_ids")).unionByName(picks.select(*keys, "_at", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "agent_ids"))
    # numbers run down, so that the last row seen is the one wanted and the frame only grows
    down = Window.partitionBy(*keys).orderBy(F.col("_at").desc(), F.col("agent_ids").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_at"))).over(Window.partitionBy(*keys))
    met = both.withColumn("_hit", F.coalesce(F.last("_row", ignorenulls=True).over(down), last))
    return met.where("agent_ids IS NOT NULL").drop("_row").withColumnRenamed("_hit", "_row")


def _digits(x, n: int):
    """The first hexadecimal digits of a text's MD5 digest as a number, which other engines can compute as well."""
    return F.conv(F.substring(F.md5(x.cast("string").cast("binary")), 1, n), 16, 10).cast("bigint")


def weighted_resample(df: DataFrame, market: str, order: str, weight: str, draws: int = 200, seed: int = 20260307, parts: int = PARTS) -> DataFrame:
    """``draws`` rows of each market, drawn in proportion to their weights, with ``agent_ids`` from 1.

    Weights that are missing, infinite or not positive draw nothing; a market without a valid weight draws evenly. Each draw is
    a uniform number made of seed, market and draw, so results do not depend on partitioning; it falls into the row whose
    interval of cumulated weight holds it. Rows are cumulated within parts of a market and the parts' sums, few numbers, among
    each other, so that no task has a market to itself. A part is cut into ranges of a whole-numbered order: all rows are read
    for the ranges' sums, and only those of the ranges that hold a draw are sorted.
    """
    ranged = isinstance(df.schema[order].dataType, IntegralType)
    known = df.where(F.col(market).isNotNull()).withColumn("_part", (_digits(F.col(order), 4) % parts).cast("int"))
    valid = finite(weight) & (F.col(weight) > 0)
    weighed = once(known.withColumn("_valid", F.when(valid, F.col(weight)).otherwise(0.0)))  # read three times
    place = F.col(order).cast("double") if ranged else F.lit(0.0)
    sums = weighed.groupBy(market, "_part").agg(F.sum("_valid").alias("_sum"), F.count("*").alias("_n"), F.min(place).alias("_low"), F.max(place).alias("_high"))
    w = Window.partitionBy(market)
    even = F.max("_sum").over(w) <= 0
    sums = sums.withColumn("_even", even).withColumn("_sum", F.when(F.col("_even"), F.col("_n").cast("double")).otherwise(F.col("_sum"))).where("_sum > 0")
    sums = sums.withColumn("_to", F.sum("_sum").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_sum").over(w))
    sums = once(sums)

    places = sums.select(market, F.col("_to").alias("_at"), F.struct("_part", (F.col("_to") - F.col("_sum")).alias("_from")).alias("_row"))
    uniform = _digits(F.concat_ws("|", F.lit(seed), F.col(market), F.col("agent_ids")), 13) / F.lit(float(1 << 52))
    picks = sums.select(market, "_all").distinct().select(market, "_all", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("agent_ids"))
    picks = _held(places, picks.select(market, (uniform * F.col("_all")).alias("_at"), "agent_ids"), [market])
    picks = picks.select(market, F.col("_row._part").alias("_part"), (F.col("_at") - F.col("_row._from")).alias("_at"), "agent_ids")

    rows = weighed.join(sums.select(market, "_part", "_even", "_low", "_high"), [market, "_part"]).withColumn("_p", F.when(F.col("_even"), 1.0).otherwise(F.col("_valid"))).where("_p > 0")
    far = (place - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * RANGES
    rows = rows.withColumn("_range", F.when(place.isNull(), -1).otherwise(F.coalesce(F.floor(far).cast("int"), F.lit(0))))  # missing ones come first
    upto = Window.partitionBy(market, "_part").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = rows.groupBy(market, "_part", "_range").agg(F.sum("_p").alias("_sum")).withColumn("_at", F.sum("_sum").over(upto))
    ranges = ranges.select(market, "_part", "_at", F.struct("_range", (F.col("_at") - F.col("_sum")).alias("_from")).alias("_row"))
    picks = _held(ranges, picks, [market, "_part"])
    picks = once(picks.select(market, "_part", F.col("_row._range").alias("_range"), (F.col("_at") - F.col("_row._from")).alias("_at"), "agent_ids"))

    within = [market, "_part", "_range"]
    rows = rows.join(picks.select(*within).distinct(), within, "left_semi")
    running = Window.partitionBy(*within).orderBy(order, "_p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*within, F.sum("_p").over(running).alias("_at"), F.struct(*df.columns).alias("_row"))
    return _held(rows, picks, within).select("_row.*", "agent_ids")
