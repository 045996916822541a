"""Answers kept one by one: a Spark data source that asks a provider for each row and writes each answer before the next.

A folder holds runs, a run one file of JSON lines for each task. While a task works, every ``every`` answers are a piece of their
own, written aside and renamed, so a piece is whole or not there. A task that is run again reads the pieces of its earlier
attempts and asks for the rest; a run that was cut off leaves its pieces to the next run. Files are read through pyarrow's
file system for the folder's scheme.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from psephos.streaming.collect import attempt

LINES = "target_id string, status string, raw string, tries int, at double"


@dataclass
class Kept(WriterCommitMessage):
    """What a task has kept: its file and the number of its answers."""

    file: str
    answers: int


class AnswerWriter(DataSourceWriter):
    def __init__(self, folder: str, run: str, ask: Callable[[dict], str], every: int) -> None:
        self.folder, self.run, self.ask, self.every = folder, run, ask, every

    def write(self, rows: Iterator[Row]) -> Kept:
        task = TaskContext.get()
        return self.keep(rows, task.partitionId(), task.attemptNumber())

    def keep(self, rows: Iterator[Row], part: int, number: int) -> Kept:
        """Ask for what no earlier attempt of this part has an answer for; then all pieces become one file."""
        fs, base = pafs.FileSystem.from_uri(f"{self.folder}/run={self.run}")
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{part:06d}"
        pieces = self._pieces(fs, base, part)
        known = {json.loads(line)["target_id"] for p in pieces for line in self._lines(fs, p)}
        held: list[str] = []
        count = 0

        def flush() -> None:
            nonlocal count
            if held:
                piece = f"{name}-{number:03d}-{count:08d}.json"
                count += 1
                self._put(fs, piece, held)
                pieces.append(piece)
                held.clear()

        for row in rows:
            request = row.asDict()
            if request["target_id"] in known:
                continue
            known.add(request["target_id"])
            status, raw, tries = attempt(self.ask, request)
            answer = {"target_id": request["target_id"], "status": status, "raw": raw, "tries": tries, "at": time.time()}
            held.append(json.dumps(answer, ensure_ascii=False))
            if len(held) >= self.every:
                flush()
        flush()
        whole = f"{name}.json"
        if pieces != [whole] and pieces:
            self._put(fs, whole, (line for p in pieces for line in self._lines(fs, p)))
            for p in pieces:
                if p != whole:  # what a crash leaves here is there twice, and read once
                    fs.delete_file(p)
        return Kept(whole, len(known))

    def commit(self, messages: list[Kept | None]) -> None:
        """The marker of a run that went to its end, with the number of its answers."""
        fs, base = pafs.FileSystem.from_uri(f"{self.folder}/run={self.run}")
        fs.create_dir(base, recursive=True)
        self._put(fs, f"{base}/_SUCCESS", [json.dumps({"answers": sum(m.answers for m in messages if m)})])

    def abort(self, messages: list[Kept | None]) -> None:
        """What has been answered stays."""

    @staticmethod
    def _pieces(fs: pafs.FileSystem, base: str, part: int) -> list[str]:
        have = (f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.is_file)
        return sorted(p for p in have if p.rsplit("/", 1)[1].startswith(f"part-{part:06d}") and p.endswith(".json"))

    @staticmethod
    def _lines(fs: pafs.FileSystem, path: str) -> Iterator[str]:
        with fs.open_input_stream(path) as f:
            for line in io.TextIOWrapper(f, encoding="utf-8", newline="\n"):
                yield line.rstrip("\n")

    @staticmethod
    def _put(fs: pafs.FileSystem, path: str, lines: Iterable[str]) -> None:
        folder, name = path.rsplit("/", 1)
        aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as f:
            for line in lines:
                f.write(f"{line}\n".encode())
        fs.move(aside, path)


def answer_sink(ask: Callable[[dict], str], run: str, every: int) -> type[DataSource]:
    """A data source that writes with ``ask``; a class of its own, so that the provider never is an option that logs show."""

    class AnswerSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"answers_{run}"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return AnswerWriter(self.options["path"], run, ask, every)

    return AnswerSink


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Each target's answer: its first good one, else its last. Runs that were cut off count."""
    rows = spark.read.schema(f"{LINES}, run string").json(folder)
    good = F.col("status") == "ok"
    order = F.struct((~good).alias("bad"), F.when(good, F.col("at")).otherwise(-F.col("at")).alias("at"), "run", "status", "raw", "tries")
    first = rows.where("target_id IS NOT NULL").groupBy("target_id").agg(F.min(order).alias("a"))
    return first.select("target_id", "a.status", "a.raw", "a.tries")


def collect_one_by_one(targets: DataFrame, ask: Callable[[dict], str], folder: str, tasks: int = 32, every: int = 1) -> DataFrame:
    """Answers for all targets, kept in ``folder`` as they come; those with a good answer there are not asked again.

    ``folder`` has to be one that the driver and all executors share. Targets are dealt to ``tasks`` by their ids, so an attempt
    that is run again has the same targets; a target that has several rows is asked for once, one without id never. ``every`` is
    how many answers may be lost with an executor: a piece costs a file, an answer of a remote model seconds.
    """
    spark, run = targets.sparkSession, uuid.uuid4().hex
    todo = targets.where("target_id IS NOT NULL")
    fs, base = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(base).type == pafs.FileType.Directory and fs.get_file_info(pafs.FileSelector(base)):
        todo = todo.join(answers(spark, folder).where("status = 'ok'").select("target_id"), "target_id", "left_anti")
    spark.dataSource.register(answer_sink(ask, run, every))
    todo.repartition(tasks, "target_id").write.format(f"answers_{run}").mode("append").option("path", folder).save()
    return answers(spark, folder)
