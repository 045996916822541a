"""A session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI mode stays on (casts that may fail are written as such); AQE sizes and splits shuffles at run time.
SETTINGS = {
    "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "psephos", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
