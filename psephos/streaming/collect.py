"""Resumable enrichment: what has no good answer yet is asked for, and answers are kept.

The provider is a plain function of a request row; tests and offline runs replay recorded answers, and nothing here opens a
network connection by itself.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.sources.resolve import exists
from psephos.streaming.first_seen import watch

ANSWER = "target_id string, status string, raw string, tries int"
MOST_TRIES, MOST_WAIT = 5, 20.0


def attempt(ask: Callable[[dict], str], request: dict, tries: int = MOST_TRIES, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str, int]:
    """(status, answer, tries): repeated with growing pauses on errors; an answer must hold a JSON object."""
    for k in range(1, tries + 1):
        try:
            raw = ask(request)
        except Exception as e:  # noqa: BLE001  any provider's error is recorded and tried again
            if k == tries:
                return "error", str(e), k
            sleep(min(2.0**k, MOST_WAIT))
            continue
        if not raw:
            return "no_output_text", "", k
        try:
            json.loads(raw[raw.find("{") : raw.rfind("}") + 1])
        except ValueError:
            return "invalid_json", raw, k
        return "ok", raw, k
    return "error", "", tries


def first_that_works(providers: list[Callable[[dict], str]]) -> Callable[[dict], str]:
    """A provider that falls back to the next one on errors."""

    def ask(request: dict) -> str:
        for k, p in enumerate(providers):
            try:
                return p(request)
            except Exception:  # noqa: BLE001
                if k == len(providers) - 1:
                    raise
        raise ValueError("no provider")

    return ask


def replay(answers: dict[str, str]) -> Callable[[dict], str]:
    """A provider that knows its answers."""
    return lambda request: answers.get(request["target_id"], "")


def recorded(request: dict) -> str:
    """A provider whose answers come with the requests, as a column that is NULL where there is none."""
    return request["answer"] or ""


def collect(targets: DataFrame, ask: Callable[[dict], str], done: DataFrame | None = None) -> DataFrame:
    """Answers for the targets that ``done`` has no good answer for; each partition asks for its own."""
    todo = targets if done is None else targets.join(done.where("status = 'ok'").select("target_id"), "target_id", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(r["target_id"], *attempt(ask, r)) for r in p.to_dict("records")]
            yield pd.DataFrame(rows, columns=["target_id", "status", "raw", "tries"])

    return todo.mapInPandas(run, ANSWER)


def collect_in_rounds(targets: DataFrame, ask: Callable[[dict], str], out: str, rounds: int = 20) -> DataFrame:
    """Answers kept round by round under ``out``: targets are dealt out by their ids, a round that is there is not asked again,
    and a lost executor costs the answers of its tasks in the round under way at most. Returns all answers."""
    spark = targets.sparkSession
    for k in range(rounds):
        part = f"{out}/round={k}"
        if not exists(spark, part):
            collect(targets.where(F.pmod(F.xxhash64("target_id"), F.lit(rounds)) == k), ask).write.mode("overwrite").json(part)
    return spark.read.schema(f"{ANSWER}, round int").json(out).drop("round")


__all__ = ["attempt", "collect", "collect_in_rounds", "first_that_works", "recorded", "replay", "watch"]
