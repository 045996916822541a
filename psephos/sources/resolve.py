"""Columns and files named by ordered lists of candidates."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str, marker: str = "/_SUCCESS") -> bool:
    """Whether a table that Spark writes is there and complete (by its marker), in whatever store it lies."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    done = hadoop.Path(f"{path}{marker}")
    return bool(done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done))


def first_column(df: DataFrame, candidates: Iterable[str], any_case: bool = False) -> str | None:
    """The first candidate that the table has."""
    have = {c: c for c in df.columns}
    if any_case:
        have |= {c.lower(): c for c in reversed(df.columns)}
    for c in candidates:
        if c in have:
            return have[c]
        if any_case and c.lower() in have:
            return have[c.lower()]
    return None


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")


def harmonised(df: DataFrame, wanted: dict[str, tuple[list[str], str]]) -> DataFrame:
    """Canonical columns: for each name its candidates and type; NULL where no candidate exists."""

    def pick(name: str, candidates: list[str], kind: str) -> Column:
        found = first_column(df, candidates)
        return (F.col(f"`{found}`").try_cast(kind) if found else F.lit(None).cast(kind)).alias(name)

    return df.select(*(pick(n, c, k) for n, (c, k) in wanted.items()))


def with_columns_present(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The table with missing columns added as NULL."""
    return df.withColumns({n: F.lit(None).cast(k) for n, k in wanted.items() if n not in df.columns})


def keep_present(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(n for n in names if n in df.columns))


def front(df: DataFrame, names: list[str]) -> DataFrame:
    """Some columns first, the rest as it was."""
    first = [n for n in names if n in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))


def family(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]


def between(df: DataFrame, first: str, last: str) -> list[str]:
    """The columns from one to another."""
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def pick_code_column(df: DataFrame, pattern: str = r"\bper\d+\b") -> str | None:
    """The first column with a value that looks like a code; one pass."""
    row = df.agg(*(F.max(F.coalesce(F.col(f"`{c}`").cast("string").rlike(pattern), F.lit(False))).alias(c) for c in df.columns)).first()
    return next((c for c in df.columns if row[c]), None)


def pick_sign_column(df: DataFrame, word: str) -> str | None:
    """The first column whose name holds ``word`` and whose numbers are all -1 or 1."""
    named = [c for c in df.columns if word in c.lower()]
    if not named:
        return None
    row = df.agg(*(F.bool_and(F.abs(F.col(f"`{c}`").try_cast("double")) == 1).alias(c) for c in named)).first()
    return next((c for c in named if row[c]), None)


def first_path(candidates: Iterable[str | Path], label: str = "input") -> Path:
    """The first path that exists."""
    tried = [Path(c) for c in candidates]
    for p in tried:
        if p.exists():
            return p
    raise FileNotFoundError(f"{label}: none of {', '.join(map(str, tried))}")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder, not made yet, below the one that the session names in spark.checkpoint.dir. Where it names none, a session
    whose tasks all run in this process gets a temporary one; a cluster has to name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='psephos-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
