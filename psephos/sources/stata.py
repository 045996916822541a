"""Stata files (releases 113 to 119): records of one width, decoded into Arrow batches without a Python object for a cell.

The driver reads the header. A task seeks its rows, tests the columns that :func:`scan` names, and decodes the wanted columns
for the rows that are left. Whole numbers are bigint, others double, dates timestamps in UTC; missing values of all kinds are
NULL, texts end at their first NUL byte.
"""

from __future__ import annotations

import json
import math
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

#: Rows that one task reads, and rows decoded at a time.
ROWS, BATCH = 50_000, 10_000
#: Fixed values of the format: types (113 to 115, then 117 on), largest values that are not missing.
OLD_TYPES = {251: "i1", 252: "i2", 253: "i4", 254: "f4", 255: "f8"}
NEW_TYPES = {65530: "i1", 65529: "i2", 65528: "i4", 65527: "f4", 65526: "f8", 32768: "strL"}
LARGEST = {"i1": 100, "i2": 32740, "i4": 2147483620, "f4": float.fromhex("0x1.fffffep126"), "f8": float.fromhex("0x1.fffffffffffffp1022")}
#: Widths of names, formats, value label names and variable labels by release.
WIDTHS = {113: (33, 12, 33, 81), 114: (33, 49, 33, 81), 115: (33, 49, 33, 81), 117: (33, 49, 33, 81), 118: (129, 57, 129, 321), 119: (129, 57, 129, 321)}
EPOCH = np.datetime64("1960-01-01")
#: A test of a column: its name, a sign and a value.
Test = tuple[str, str, object]
SIGNS = {"=": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}


@dataclass
class Header:
    """Where the records of a file are and what they hold; ``kinds`` are "i1" to "f8", "S" and a width, or "strL"."""

    release: int
    order: str
    rows: int
    names: list[str]
    kinds: list[str]
    formats: list[str]
    labels: list[str]
    data: int
    strls: int

    @property
    def text(self) -> str:
        return "utf-8" if self.release >= 118 else "latin-1"

    def record(self, names: Iterable[str]) -> np.dtype:
        """Only these fields, at their places in a whole record."""
        sizes = [8 if k == "strL" else np.dtype(k).itemsize for k in self.kinds]
        starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        places = [self.names.index(n) for n in names]
        kinds = ["V8" if self.kinds[p] == "strL" else self.kinds[p] if self.kinds[p][0] == "S" else self.order + self.kinds[p] for p in places]
        return np.dtype({"names": [self.names[p] for p in places], "formats": kinds, "offsets": [starts[p] for p in places], "itemsize": starts[-1]})

    def unit(self, name: str) -> str | None:
        """The unit of a date column: d, c (milliseconds), w, m, q, h or y."""
        f = self.formats[self.names.index(name)].lstrip("%-")
        return f[1].lower() if f[:1] == "t" and f[1:2].lower() in tuple("dcwmqhy") else "d" if f[:1] == "d" else None


def opened(path: str) -> pa.NativeFile:
    fs, name = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    return fs.open_input_file(name)


def read_header(f: pa.NativeFile) -> Header:
    first = f.read(11)
    return _new_header(f) if first == b"<stata_dta>" else _old_header(f, first)


def _texts(f: pa.NativeFile, n: int, width: int, encoding: str) -> list[str]:
    raw = f.read(n * width)
    return [raw[k * width : (k + 1) * width].split(b"\0")[0].decode(encoding, "replace") for k in range(n)]


def _old_header(f: pa.NativeFile, first: bytes) -> Header:
    release, order = first[0], ">" if first[1] == 1 else "<"
    if release not in WIDTHS:
        raise ValueError(f"not a Stata file of a known release ({release})")
    n, rows = struct.unpack(order + "HI", first[4:10])
    f.seek(109)
    kinds = [OLD_TYPES.get(t, f"S{t}") for t in f.read(n)]
    a, b, c, d = WIDTHS[release]
    names = _texts(f, n, a, "latin-1")
    f.read(2 * (n + 1))
    formats = _texts(f, n, b, "latin-1")
    f.read(n * c)
    labels = _texts(f, n, d, "latin-1")
    while True:  # fields that later releases may add
        kind, size = struct.unpack(order + "BI", f.read(5))
        if not kind and not size:
            return Header(release, order, rows, names, kinds, formats, labels, f.tell(), 0)
        f.read(size)


def _new_header(f: pa.NativeFile) -> Header:
    f.read(len("<header><release>"))
    release = int(f.read(3))
    if release not in WIDTHS:
        raise ValueError(f"not a Stata file of a known release ({release})")
    f.read(len("</release><byteorder>"))
    order = ">" if f.read(3) == b"MSF" else "<"
    f.read(len("</byteorder><K>"))
    n = struct.unpack(order + ("I" if release == 119 else "H"), f.read(4 if release == 119 else 2))[0]
    f.read(len("</K><N>"))
    rows = struct.unpack(order + ("I" if release == 117 else "Q"), f.read(4 if release == 117 else 8))[0]
    f.read(len("</N><label>"))
    f.read(f.read(1)[0] if release == 117 else struct.unpack(order + "H", f.read(2))[0])
    f.read(len("</label><timestamp>"))
    f.read(f.read(1)[0])
    f.read(len("</timestamp></header><map>"))
    at = struct.unpack(order + "14Q", f.read(112))
    encoding = "utf-8" if release >= 118 else "latin-1"

    def section(k: int, tag: str, width: int) -> list[str]:
        f.seek(at[k] + len(tag))
        return _texts(f, n, width, encoding)

    a, b, _, d = WIDTHS[release]
    f.seek(at[2] + len("<variable_types>"))
    kinds = [NEW_TYPES.get(t, f"S{t}") for t in struct.unpack(f"{order}{n}H", f.read(2 * n))]
    names, formats, labels = section(3, "<varnames>", a), section(5, "<formats>", b), section(7, "<variable_labels>", d)
    return Header(release, order, rows, names, kinds, formats, labels, at[9] + len("<data>"), at[10] + len("<strls>"))


def fixed_texts(cells: np.ndarray, encoding: str) -> pa.Array:
    """Texts of one width up to their first NUL, by one comparison over the bytes; others than ASCII or UTF-8 are decoded singly."""
    width = cells.dtype.itemsize
    if not len(cells):
        return pa.array([], pa.string())
    octets = np.ascontiguousarray(cells).view(np.uint8).reshape(len(cells), width)
    keep = np.logical_and.accumulate(octets != 0, axis=1)
    data, ends = octets[keep], np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
    out = pa.Array.from_buffers(pa.string(), len(cells), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    if data.size and data.max() >= 128:
        try:
            if encoding != "utf-8":
                raise pa.ArrowInvalid("another encoding")
            out.validate(full=True)
        except pa.ArrowInvalid:
            raw = data.tobytes()
            out = pa.array([raw[a:b].decode(encoding, "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
    return out


def moments(values: np.ndarray, known: np.ndarray, unit: str) -> np.ndarray:
    """Microseconds since 1970 of dates counted from 1960 in a unit."""
    v = np.where(known, values, 0)
    if unit == "c":
        return (EPOCH.astype("datetime64[ms]") + v.astype("int64").astype("timedelta64[ms]")).astype("datetime64[us]").astype("int64")
    v = np.floor(v).astype("int64")
    if unit == "d":
        day = EPOCH + v.astype("timedelta64[D]")
    elif unit == "w":  # 52 weeks a year
        day = (np.datetime64("1960", "Y") + (v // 52).astype("timedelta64[Y]")).astype("datetime64[D]") + (v % 52 * 7).astype("timedelta64[D]")
    elif unit == "y":
        day = (np.datetime64("1970", "Y") + (v - 1970).astype("timedelta64[Y]")).astype("datetime64[D]")
    else:
        day = (np.datetime64("1960-01", "M") + (v * {"m": 1, "q": 3, "h": 6}[unit]).astype("timedelta64[M]")).astype("datetime64[D]")
    return day.astype("datetime64[us]").astype("int64")


def column(h: Header, name: str, cells: np.ndarray, long_texts: dict[bytes, str]) -> pa.Array:
    stored = h.kinds[h.names.index(name)]
    if stored == "strL":
        return pa.array([long_texts.get(c.tobytes(), "") for c in cells], pa.string())
    if stored[0] == "S":
        return fixed_texts(cells, h.text)
    known = cells <= LARGEST[stored]
    if unit := h.unit(name):
        return pa.array(moments(cells, known, unit), mask=~known).cast(pa.timestamp("us", "UTC"))
    wide = cells.astype("int64" if stored[0] == "i" else "float64")
    return pa.array(wide, mask=~known)


def long_texts(f: pa.NativeFile, h: Header, wanted: set[bytes]) -> dict[bytes, str]:
    """The long texts that some cells point to, by those cells; the section is passed once, and only these are kept."""
    out: dict[bytes, str] = {}
    small, big = (4, 4) if h.release == 117 else (2, 6) if h.release == 118 else (3, 5)
    name = "little" if h.order == "<" else "big"
    wanted = wanted - {bytes(8)}
    f.seek(h.strls)
    while len(out) < len(wanted) and f.read(3) == b"GSO":
        v, o = struct.unpack(h.order + ("II" if h.release == 117 else "IQ"), f.read(8 if h.release == 117 else 12))
        kind, size = struct.unpack(h.order + "BI", f.read(5))
        key = v.to_bytes(small, name) + o.to_bytes(big, name)
        if key in wanted:
            raw = f.read(size)
            out[key] = (raw.rstrip(b"\0") if kind == 130 else raw).decode(h.text, "replace")
        else:
            f.seek(size, os.SEEK_CUR)
    return out


def holds(sign: str, value: object, values: pa.Array) -> np.ndarray:
    """Where a test is true; NULL is not. Whole numbers of these files fit a double, so numbers are compared as doubles."""
    if pa.types.is_integer(values.type):
        values = values.cast(pa.float64())
    if sign == "known":
        out = pc.is_valid(values)
    elif sign == "in":
        out = pc.and_(pc.is_in(values, value_set=pa.array(value).cast(values.type)), pc.is_valid(values))
    else:
        out = pc.fill_null(SIGNS[sign](values, pa.scalar(value).cast(values.type)), False)
    return out.to_numpy(zero_copy_only=False)


class Rows(D.InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        super().__init__(start)
        self.start, self.stop = start, stop


class StataReader(D.DataSourceReader):
    def __init__(self, path: str, schema: StructType, where: Iterable[Test] = ()) -> None:
        self.path, self.arrow, self.where = path, to_arrow_schema(schema), [tuple(t) for t in where]

    def partitions(self) -> list[D.InputPartition]:
        with opened(self.path) as f:
            n = read_header(f).rows
        return [Rows(k, min(k + ROWS, n)) for k in range(0, max(n, 1), ROWS)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        yield from self.batches(partition.start, partition.stop)

    def batches(self, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as f:
            h = read_header(f)
            asked = list(dict.fromkeys([*self.arrow.names, *(name for name, _, _ in self.where)]))
            record = h.record(asked)
            far = [n for n in asked if h.kinds[h.names.index(n)] == "strL"]
            for at in range(start, stop, BATCH):
                f.seek(h.data + at * record.itemsize)
                rows = np.frombuffer(f.read((min(at + BATCH, stop) - at) * record.itemsize), record)
                for name, sign, value in self.where:
                    rows = rows[holds(sign, value, self._column(f, h, name, rows, far))] if len(rows) else rows
                if len(rows):
                    yield pa.RecordBatch.from_arrays([self._column(f, h, n, rows, far).cast(self.arrow.field(n).type) for n in self.arrow.names], schema=self.arrow)

    def _column(self, f: pa.NativeFile, h: Header, name: str, rows: np.ndarray, far: list[str]) -> pa.Array:
        cells = rows[name]
        texts = long_texts(f, h, {c.tobytes() for c in cells}) if name in far else {}
        return column(h, name, cells, texts)


class StataSource(D.DataSource):
    """``spark.read.format("stata").load(path)``: a partition for every 50,000 rows, variable labels as comments. :func:`scan` reads
    some columns of some rows."""

    @classmethod
    def name(cls) -> str:
        return "stata"

    def schema(self) -> StructType:
        with opened(self.options["path"]) as f:
            return fields(read_header(f))

    def reader(self, schema: StructType) -> D.DataSourceReader:
        return StataReader(self.options["path"], schema, json.loads(self.options.get("where", "[]")))


def fields(h: Header) -> StructType:
    out = StructType()
    for name, kind, label in zip(h.names, h.kinds, h.labels, strict=True):
        number = LongType() if kind[0] == "i" else DoubleType()
        t = StringType() if kind[0] in "Ss" else TimestampType() if h.unit(name) else number
        out.add(StructField(name, t, True, {"comment": label}))
    return out


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Iterable[Test] = ()) -> DataFrame:
    """Some columns of the rows that pass all tests (column, sign, value); signs are =, <, <=, >, >=, ``in`` with a list and
    ``known``, columns those of numbers or texts, whether read or not. Only rows that pass are decoded further.

    The tests are given here, not taken from Spark's filters: Spark 4.1 keeps what it pushed into a Python source with the
    DataFrame, so that a second query on it would silently miss rows.
    """
    with opened(path) as f:
        have = fields(read_header(f))
    where = [(name, sign, value) for name, sign, value in where]
    for name, sign, value in where:
        values = value if sign == "in" else [] if sign == "known" else [value]
        texts = name in have.names and isinstance(have[name].dataType, StringType)
        fair = all(isinstance(v, str) if texts else isinstance(v, (int, float)) and math.isfinite(v) for v in values)
        if name not in have.names or isinstance(have[name].dataType, TimestampType) or sign not in (*SIGNS, "in", "known") or not fair:
            raise ValueError(f"no test of a Stata column: {name} {sign} {value}")
    spark.dataSource.register(StataSource)
    schema = have if columns is None else StructType([have[c] for c in columns])
    return spark.read.format("stata").schema(schema).option("where", json.dumps(where)).load(path)
