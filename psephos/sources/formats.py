"""Readers: parquet, CSV and JSON as Spark has them, Stata files and workbooks as Python data sources."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from psephos.sources.stata import Rows as _Rows
from psephos.sources.stata import StataReader, StataSource

class _StataReader(StataReader):
    """Rows as tuples, for use without Spark."""

    def read(self, partition: _Rows) -> Iterator[tuple]:
        for b in self.batches(partition.start, partition.stop):
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(path)``: the first sheet of an .xlsx file, header in its first row, all text."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        out = StructType()
        for k, name in enumerate(next(sheet_rows(self.options["path"]), [])):
            out.add(StructField(name or f"column_{k + 1}", StringType(), True))
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WorkbookReader(self.options["path"], len(schema))


class _WorkbookReader(DataSourceReader):
    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        rows = sheet_rows(self.path)
        next(rows, None)
        for r in rows:
            yield tuple((r + [None] * self.width)[: self.width])


MAIN, LINKS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def first_sheet(z: zipfile.ZipFile) -> str:
    """The member that holds the first sheet as the workbook lists them (chart sheets have no cells and are passed over); where
    there is no list, the sheet file with the least number."""
    have = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= have:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = targets.get(sheet.get(f"{LINKS}id"), "")
            member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if member in have and "chartsheets/" not in member:
                return member
    return min((n for n in have if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))


def _elements(z: zipfile.ZipFile, member: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag one after the other; what has been read is let go."""
    with z.open(member) as f:
        root = None
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if root is None:
                root = e
            if event == "end" and e.tag == tag:
                yield e
                e.clear()
                for parent in (root, *root):  # rows lie below the root or below one of its children
                    if len(parent) and parent[-1] is e:
                        parent.remove(e)


def _said(e: ElementTree.Element) -> str:
    """The text of a cell or shared string, without its phonetic readings."""
    return "".join(t.text or "" for part in ([e] if e.find(f"{MAIN}r") is None else e.findall(f"{MAIN}r")) for t in part.findall(f"{MAIN}t"))


def sheet_rows(path: str) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet as texts; rows that the file leaves out are not made up."""
    with zipfile.ZipFile(path) as z:
        shared = [_said(s) for s in _elements(z, "xl/sharedStrings.xml", f"{MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        for row in _elements(z, first_sheet(z), f"{MAIN}row"):
            out: list[str | None] = []
            for cell in row.iter(f"{MAIN}c"):
                at = 0
                for c in re.match(r"[A-Z]*", cell.get("r", ""))[0]:
                    at = at * 26 + ord(c) - 64
                out += [None] * ((at or len(out) + 1) - 1 - len(out))
                value, inner = cell.find(f"{MAIN}v"), cell.find(f"{MAIN}is")
                if cell.get("t") == "inlineStr":
                    out.append(None if inner is None else _said(inner))
                elif value is None or value.text is None:
                    out.append(None)
                else:
                    out.append(shared[int(value.text)] if cell.get("t") == "s" else value.text)
            yield out


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(StataSource)
    spark.dataSource.register(WorkbookSource)


def load(spark: SparkSession, path: str, schema: StructType | str | None = None, dates: tuple[str, ...] = ()) -> DataFrame:
    """A table by the ending of its name; columns named in ``dates`` become dates where they exist."""
    end = Path(path).suffix.lower()
    if end in (".dta", ".xlsx"):
        register(spark)
        df = spark.read.format("stata" if end == ".dta" else "workbook").load(path)
    elif end == ".csv":
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    elif end in (".json", ".jsonl"):
        df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    else:
        df = spark.read.parquet(path)
    return df.withColumns({d: F.try_to_date(F.col(d).cast("string")) for d in dates if d in df.columns})


def load_first(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """The first of several files that exists, in whatever format."""
    from psephos.sources.resolve import first_path

    return load(spark, str(first_path(paths, "table")), **options)
