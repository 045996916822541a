"""A graph of stages that hand over by stage tables, are reused while nothing that they depend on changes, and log what they did."""

from __future__ import annotations

import argparse
import hashlib
import json
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from graphlib import TopologicalSorter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from psephos.sources.resolve import exists
from psephos.sources.sinks import write_report


@dataclass
class Stage:
    """A step: its name, the tables that it makes, the function that makes them, the stage tables that it reads (``inputs``), and
    the folders or files that it reads besides (``sources``)."""

    name: str
    outputs: list[str]
    run: Callable[[SparkSession, Settings], dict[str, DataFrame]]
    optional: bool = False
    inputs: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)


@dataclass
class Settings:
    """Where tables lie and what to do. ``extra`` has the stages' parameters: JSON objects by the stage's name."""

    folder: str
    overwrite: bool = False
    dry_run: bool = False
    skip: list[str] = field(default_factory=list)
    extra: dict[str, str] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}.parquet"

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """A stage table."""
        return spark.read.parquet(self.path(name))

    def parameters(self, stage: str) -> dict:
        return json.loads(self.extra.get(stage, "{}"))


@dataclass
class Step:
    """What happened to a stage."""

    name: str
    status: str
    seconds: float = 0.0
    outputs: list[str] = field(default_factory=list)
    note: str = ""


class Store:
    """Files of stage tables, in whatever store they lie."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self.of = lambda path: self.hadoop.Path(path).getFileSystem(conf)
        self.folder = folder

    def listing(self, path: str) -> list[tuple[str, int, int]]:
        """Name, length and time of the files under a path."""
        fs, at = self.of(path), self.hadoop.Path(path)
        if not fs.exists(at):
            return []
        found, files = [], fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(found)

    def replace(self, new: str, old: str) -> None:
        """Put a table that has been written in the place of another, which could be read until now."""
        fs = self.of(old)
        fs.delete(self.hadoop.Path(old), True)
        if not fs.rename(self.hadoop.Path(new), self.hadoop.Path(old)):
            raise OSError(f"{new} could not be moved to {old}")

    def mark(self, stage: str) -> str:
        return f"{self.folder.rstrip('/')}/_{stage}.fingerprint"

    def fingerprint(self, stage: str) -> str:
        """The fingerprint with which a stage has last been done; empty if it has not."""
        fs, at = self.of(self.mark(stage)), self.hadoop.Path(self.mark(stage))
        if not fs.exists(at):
            return ""
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, stage: str, fingerprint: str) -> None:
        stream = self.of(self.mark(stage)).create(self.hadoop.Path(self.mark(stage)), True)
        try:
            stream.write(bytearray(fingerprint.encode()))
        finally:
            stream.close()


class Pipeline:
    """Stages, each after those whose tables it reads; a failing one ends the run with its error in the log, an optional one does
    not. A stage is done again when the files of its inputs or sources, or its parameters, are others than when it was last done,
    or an output is missing."""

    def __init__(self, stages: Sequence[Stage]) -> None:
        maker = {o: s.name for s in stages for o in s.outputs}
        by_name = {s.name: s for s in stages}
        if len(by_name) < len(stages) or len(maker) < sum(len(s.outputs) for s in stages):
            raise ValueError("two stages or tables have one name")
        if missing := [i for s in stages for i in s.inputs if i not in maker]:
            raise ValueError(f"no stage makes {', '.join(missing)}")
        graph = TopologicalSorter()
        for s in stages:
            graph.add(s.name, *dict.fromkeys(maker[i] for i in s.inputs))
        graph.prepare()  # a cycle raises
        self.stages: list[Stage] = []
        while graph.is_active():
            ready = sorted(graph.get_ready(), key=list(by_name).index)
            self.stages += [by_name[n] for n in ready]
            graph.done(*ready)
        if [s.name for s in self.stages] != list(by_name) and self._ordered(stages, maker):
            self.stages = list(stages)  # as given, where that serves
        self.maker = maker
        self.steps: list[Step] = []

    @staticmethod
    def _ordered(stages: Sequence[Stage], maker: dict[str, str]) -> bool:
        place = {s.name: k for k, s in enumerate(stages)}
        return all(place[maker[i]] < place[s.name] for s in stages for i in s.inputs)

    def run(self, spark: SparkSession, settings: Settings) -> int:
        """The number of failed stages (0 or 1, as the first ends the run)."""
        store, planned = Store(spark, settings.folder), set()
        for stage in self.stages:
            paths = [settings.path(o) for o in stage.outputs]
            if stage.name in settings.skip:
                self.steps.append(Step(stage.name, "skipped", outputs=paths, note="on request"))
                continue
            now = self.fingerprint(stage, settings, store)
            upstream = planned & {self.maker[i] for i in stage.inputs}
            if not settings.overwrite and not upstream and paths and all(exists(spark, p) for p in paths) and store.fingerprint(stage.name) == now:
                self.steps.append(Step(stage.name, "reused", outputs=paths))
                continue
            if settings.dry_run:
                planned.add(stage.name)
                self.steps.append(Step(stage.name, "planned", outputs=paths))
                continue
            began = time.monotonic()
            try:
                made = stage.run(spark, settings)
                for name, df in made.items():
                    df.write.mode("overwrite").parquet(f"{settings.path(name)}.new")
                for name in made:  # what is there can be read until all is written
                    store.replace(f"{settings.path(name)}.new", settings.path(name))
                store.put(stage.name, now)
                self.steps.append(Step(stage.name, "done", round(time.monotonic() - began, 3), paths))
            except Exception as e:  # noqa: BLE001  the log has to tell of any failure
                self.steps.append(Step(stage.name, "failed", round(time.monotonic() - began, 3), paths, f"{type(e).__name__}: {e}"[:500]))
                if not stage.optional:
                    return 1
        return 0

    def fingerprint(self, stage: Stage, settings: Settings, store: Store) -> str:
        """Of what a stage depends on."""
        files = {i: store.listing(settings.path(i)) for i in stage.inputs} | {p: store.listing(p) for p in stage.sources}
        return hashlib.sha256(json.dumps([stage.name, stage.outputs, settings.parameters(stage.name), files], sort_keys=True).encode()).hexdigest()

    def log(self) -> list[dict]:
        return [asdict(s) for s in self.steps]

    def write_log(self, path: str | Path) -> None:
        write_report(self.log(), str(path))


def prefer(spark: SparkSession, settings: Settings, names: Sequence[str]) -> str:
    """The first of several stage tables that is there: patched before repaired before collected."""
    for n in names:
        if exists(spark, settings.path(n)):
            return settings.path(n)
    raise FileNotFoundError(f"none of {', '.join(names)} in {settings.folder}")


def survey_stages(tables: str) -> list[Stage]:
    """The whole chain on the tables under ``tables`` (:mod:`psephos.plans.survey`)."""
    from psephos.plans import survey

    return survey.survey_stages(tables)


def arguments(argv: Sequence[str] | None = None) -> tuple[argparse.Namespace, Settings]:
    p = argparse.ArgumentParser(description="Run the survey pipeline.")
    p.add_argument("--tables", required=True, help="folder of the input tables")
    p.add_argument("--folder", required=True, help="folder of the stage tables")
    p.add_argument("--overwrite", action="store_true", help="make tables that are there again")
    p.add_argument("--dry-run", action="store_true", help="only tell what would be done")
    p.add_argument("--skip", nargs="*", default=[], help="stages to leave out")
    p.add_argument("--log", help="file for the run log")
    p.add_argument("--set", nargs="*", default=[], metavar="STAGE=JSON", help="parameters of stages")
    a = p.parse_args(argv)
    return a, Settings(a.folder, a.overwrite, a.dry_run, a.skip, dict(x.split("=", 1) for x in a.set))


def main(argv: Sequence[str] | None = None) -> int:
    from psephos.session import session

    args, settings = arguments(argv)
    chain = Pipeline(survey_stages(args.tables))
    code = chain.run(session("survey"), settings)
    print(json.dumps(chain.log(), indent=2))
    if args.log:
        chain.write_log(args.log)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
