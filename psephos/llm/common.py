"""Shared pieces of the training-data operators: shared-folder handling, Arrow helpers and word rules.

Executors may be lost at any time and see no folder of the driver's, so anything that a later job reads again is written
under ``spark.checkpoint.dir`` (see :func:`workspace`), never to a machine-local temporary folder.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the quality, near-duplicate and substring contracts: runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: ASCII-only lower case, as the contracts ask (str.lower would also fold other letters).
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

MASK = (1 << 64) - 1
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder path in the cluster's shared checkpoint folder, the session's ``spark.checkpoint.dir``.

    Where that is unset, one is made and set if all executors are in this process (local use, tests); a cluster has to name it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="psephos-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors.

    ``rows``, where known, is a bound of its rows: it then goes to a file for every 100,000 of them (eight at least), as a small
    table in very many files costs more in file handling than in work.
    """
    path = workspace(df.sparkSession, name)
    (df if rows is None else df.coalesce(max(8, rows // 100_000))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``; one Python pass, memory bounded by a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch, as texts may be very long."""
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") != str(value):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column, spelt as given or else as Spark resolves it."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


def batch_of(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], type=t) for k, t in types.items()], names=list(types))


@lru_cache(maxsize=1 << 18)
def stable_hash(word: str) -> int:
    """64 mixed bits of a word, the same in every process."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def stable_text_hash(text: str) -> int:
    """64 signed bits of a text, the same in every process."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def multipliers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, GOLDEN, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads entropy over all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a sequence of word hashes (empty when shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, m in enumerate(multipliers(k)):
            out += h[i : i + n] * m
    return mix(out)


def held_out(doc_id: int) -> bool:
    """Rows that no learner sees: crc32 of the id as text, modulo 5, is 0."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(name: str = "doc_id"):
    return F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0


#: White space of the word contracts, by byte.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Random values of the bytes, for polynomial hashes.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once.
_SLICE = 1 << 18
#: Longer words are hashed by XXH3: a polynomial modulo a power of two collides for certain words of a thousand bytes.
_SHORT = 64

_UP = np.ones(1, np.uint64)
_DOWN = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to ``n`` at least and those of its inverse."""
    global _UP, _DOWN
    if len(_UP) <= n:
        size = 1 << (n + 1).bit_length()
        with np.errstate(over="ignore"):
            _UP, _DOWN = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _UP, _DOWN


def hashed_words(data: bytes) -> np.ndarray:
    """Stable 64-bit hashes of the words (runs of other than ASCII white space) of UTF-8 bytes, without a Python step a word.

    Each word's hash is a polynomial in its bytes modulo 2**64, read off a running sum and mixed; words of more than ``_SHORT``
    bytes are hashed alone. Equal words hash equally wherever they are.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    up, down = powers(_SLICE)
    out, at = [], 0
    while at < len(raw):
        part = raw[at : at + _SLICE]
        blank = _BLANK[part]
        if at + len(part) < len(raw) and not blank[-1] or len(part) == _SLICE and not blank.any():
            ends = np.flatnonzero(blank)
            if not len(ends):  # a word of a slice or more
                stop = at + len(part)
                while stop < len(raw) and not (gap := _BLANK[raw[stop : stop + _SLICE]]).any():
                    stop += len(gap)
                stop += int(np.argmax(gap)) if stop < len(raw) else 0
                out.append(np.array([xxhash.xxh3_64_intdigest(data[at:stop])], dtype=np.uint64))
                at = stop
                continue
            part, blank = part[: ends[-1] + 1], blank[: ends[-1] + 1]
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[part] * up[: len(part)], dtype=np.uint64)])
            found = mix((total[end] - total[start]) * down[start])
        for k in np.flatnonzero(end - start > _SHORT):
            found[k] = xxhash.xxh3_64_intdigest(data[at + start[k] : at + end[k]])
        out.append(found)
        at += len(part)
    return np.concatenate(out) if out else np.empty(0, np.uint64)
