"""The first good answer of each target, on a stream: state for each target, with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

#: The setting of the state store, and the one that arbitrary processors need.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _least(rows: pd.DataFrame, order: list[str]) -> pd.DataFrame:
    """The first row by ``order``, missing values last."""
    return rows.sort_values(order, kind="stable", na_position="last").head(1)


class FirstAnswer(StatefulProcessor):
    """Lets a target's first row through and remembers that it did; of rows that come in one batch the least by ``order``."""

    def __init__(self, order: list[str], expiry_hours: float | None) -> None:
        self.order, self.expiry_hours = order, expiry_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType([StructField("seen", IntegerType())])
        ttl = None if self.expiry_hours is None else max(1, int(self.expiry_hours * 3_600_000))
        self.seen = handle.getValueState("seen", kind, ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            for _ in rows:  # what came later is read and dropped
                pass
            return
        best = None
        for part in rows:
            best = _least(part if best is None else pd.concat([best, part], ignore_index=True), self.order)
        if best is not None:
            self.seen.update((1,))
            yield best

    def close(self) -> None:
        pass


def first_answers(rows: DataFrame, order: list[str], expiry_hours: float | None = None, key: str = "target_id") -> DataFrame:
    """A stream's first row for each ``key``: the least by ``order`` (then all columns) of the first batch that has the key.

    Rows without a key never pass. A task first keeps one row for each key of its own Arrow batches, so that a key with very many
    rows shuffles few of them. State is one flag for each key, looked up by key: a batch costs what it holds, however long the
    stream has run. With ``expiry_hours`` a flag is forgotten after that time, and a key that comes again passes again.
    """
    order = [*order, *(c for c in rows.columns if c not in order)]

    def thin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.sort_values(order, kind="stable", na_position="last").drop_duplicates(key)

    thinned = rows.where(F.col(key).isNotNull()).mapInPandas(thin, rows.schema)
    mode = "None" if expiry_hours is None else "ProcessingTime"
    return thinned.groupBy(key).transformWithStateInPandas(FirstAnswer(order, expiry_hours), rows.schema, "Append", mode)


def keep_first(rows: DataFrame, order: list[str], out: str, checkpoint: str, expiry_hours: float | None = None, key: str = "target_id") -> StreamingQuery:
    """Follow a stream to its present end and keep each key's first row in ``out`` once.

    A batch has a folder of its own, ``batch=N``, which it overwrites if it is run again after a failure; state goes back to what
    it was before that batch, so the rerun writes the same rows.
    """
    spark = rows.sparkSession
    # A query takes the session's settings when it starts. State with a time to live would ask for batches without data for ever.
    settings = {STORE: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        stream = first_answers(rows, order, expiry_hours, key).writeStream.foreachBatch(put)
        return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def watch(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, expiry_hours: float | None = None) -> StreamingQuery:
    """Follow a folder of JSON lines (with ``target_id`` and ``status``); each target's first good answer is kept in ``out``."""
    rows = spark.readStream.schema(schema).json(folder).where("status = 'ok'")
    return keep_first(rows, ["target_id"], out, checkpoint, expiry_hours)
