"""Registered queries over streams and over answers kept one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.plans.base import table
from psephos.plans.registry import query
from psephos.sources.answers import collect_one_by_one
from psephos.sources.resolve import scratch
from psephos.streaming.collect import recorded
from psephos.streaming.first_seen import keep_first


@query("""SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id NULLS LAST) AS k FROM events WHERE user_id IS NOT NULL AND event_type <> 'error') WHERE k = 1""")
def stream_first_events(spark: SparkSession, d: str) -> DataFrame:
    """Each user's first event that is no error, by a stream with state for each user."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    stored = table(spark, d, "events").schema
    rows = spark.readStream.schema(stored).parquet(f"{d}/events.parque[t]")  # a pattern, so that a file will do as well as a folder
    rows = rows.where("event_type <> 'error'").select("user_id", "event_id", "event_type", "value", at)
    out = scratch(spark, "first-events")
    keep_first(rows, ["at", "event_id"], f"{out}/kept", f"{out}/checkpoint", key="user_id").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/kept").select("user_id", "event_id", "event_type", "value")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS target_id, CASE WHEN c_custkey % 3 = 0 THEN 'ok' WHEN c_custkey % 3 = 1 THEN 'no_output_text' ELSE 'invalid_json' END AS status,
CASE WHEN c_custkey % 3 = 0 THEN '{"name": "' || c_name || '"}' WHEN c_custkey % 3 = 1 THEN '' ELSE '{' || c_name END AS raw FROM customer""")
def durable_answers(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers for every customer, written by the tasks as they come and read back."""
    k, name = F.col("c_custkey"), F.col("c_name")
    answer = F.when(k % 3 == 0, F.concat(F.lit('{"name": "'), name, F.lit('"}'))).when(k % 3 == 2, F.concat(F.lit("{"), name))
    targets = table(spark, d, "customer").select(k.cast("string").alias("target_id"), answer.alias("answer"))
    return collect_one_by_one(targets, recorded, scratch(spark, "answers"), tasks=8, every=500).select("target_id", "status", "raw")
