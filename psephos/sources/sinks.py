"""Writers, and the coercions that other programs need."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, IntegralType, NullType, StringType, TimestampType

#: Longest name and label, and reserved words, of the Stata format; fixed values.
NAME_LENGTH, LABEL_LENGTH = 32, 80
RESERVED = frozenset(
    "_all _b byte _coef _cons double float if in int long _n _N _pi _pred _rc _skip str strL using with".split()
)


def stata_names(names: Iterable[str]) -> dict[str, str]:
    """A valid and distinct name for each column; only changed names are in the result."""
    used: set[str] = set()
    out: dict[str, str] = {}
    for n in names:
        base = re.sub(r"[^A-Za-z0-9_]", "_", n) or "v"
        if not re.match(r"[A-Za-z_]", base):
            base = f"v_{base}"
        if base in RESERVED or re.fullmatch(r"str\d+", base):
            base = f"{base}_"
        base = base[:NAME_LENGTH]
        name, k = base, 0
        while name.lower() in used:
            k += 1
            name = f"{base[: NAME_LENGTH - len(str(k)) - 1]}_{k}"
        used.add(name.lower())
        if name != n:
            out[n] = name
    return out


def stage_types(df: DataFrame, numeric: Iterable[str] = ()) -> DataFrame:
    """Types as they survive a stage file: dates stay, integers and flags become doubles, texts that are all numbers become
    doubles, other missing texts become empty. Which texts are numbers takes one pass."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, (StringType, NullType)) and f.name not in numeric]
    tests = [F.bool_and(F.col(f"`{c}`").try_cast("double").isNotNull() | (F.col(f"`{c}`") == "")).alias(c) for c in texts]
    any_value = [F.max(F.coalesce(F.col(f"`{c}`") != "", F.lit(False))).alias(f"{c}?") for c in texts]
    row = df.agg(*tests, *any_value).first() if texts else {}

    def cast(f) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DateType, TimestampType)):
            return c
        if f.name in numeric or isinstance(f.dataType, (IntegralType, BooleanType)) or (f.name in texts and row[f"{f.name}?"] and row[f.name]):
            return (c.cast("int") if isinstance(f.dataType, BooleanType) else c).try_cast("double").alias(f.name)
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name) if f.name in texts else c

    return df.select(*(cast(f) for f in df.schema))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_stage(df: DataFrame, path: str, labels: dict[str, str] | None = None, csv: bool = False) -> dict[str, str]:
    """A stage table as Parquet with labels as column comments (CSV too on request); returns the renamed columns."""
    names = stata_names(df.columns)
    cols = [F.col(f"`{c}`").alias(names.get(c, c), metadata={"comment": (labels or {}).get(c, "")[:LABEL_LENGTH]}) for c in df.columns]
    out = df.select(*cols)
    out.write.mode("overwrite").parquet(path)
    if csv:
        write_csv(out, f"{path}.csv")
    return names


def write_stata(df: DataFrame, path: str, most: int = 1_000_000, labels: dict[str, str] | None = None) -> dict[str, str]:
    """A table of known small size as one Stata file with labels of its variables; larger ones belong in Parquet. Returns the
    renamed columns."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write a stage table instead")
    names = stata_names(rows.columns)
    given = {names.get(c, c): x[:LABEL_LENGTH] for c, x in (labels or {}).items() if c in rows.columns}
    for c in rows.columns[[k == "O" and rows[c].isna().all() for c, k in ((c, rows[c].dtype.kind) for c in rows.columns)]]:
        rows[c] = ""  # a column without any value has no type of its own
    rows.rename(columns=names).to_stata(path, write_index=False, version=118, variable_labels=given or None)
    return names


def write_pair(df: DataFrame, base: str, labels: dict[str, str] | None = None) -> str:
    """The table as CSV (``base``.csv) and as Stata file (``base``.dta), from types that both can hold. The CSV counts: what
    goes wrong with the Stata file is returned, empty if nothing did."""
    rows = stage_types(df)
    write_csv(rows, f"{base}.csv")
    try:
        write_stata(rows, f"{base}.dta", labels=labels)
    except (ValueError, OverflowError, UnicodeError, OSError) as e:
        return f"{type(e).__name__}: {e}"
    return ""


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_requests(df: DataFrame, id_col: str, body: Column, path: str) -> None:
    """One JSON request for each row, as lines."""
    request = F.to_json(F.struct(F.col(id_col).alias("custom_id"), F.lit("POST").alias("method"), body.alias("body")))
    df.select(request.alias("value")).write.mode("overwrite").text(path)


def write_report(rows: list[dict], path: str) -> None:
    """A small report as JSON, on the driver."""
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=2, default=str))


def patched_path(path: str) -> Path:
    """Where a patched copy goes: beside the original, which stays."""
    p = Path(path)
    return p.with_name(f"{p.stem}_patched{p.suffix}")
