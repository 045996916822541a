"""The decoder of Stata files against pandas' own, and scans that read less."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from psephos.sources import formats, stata


def frame(n: int) -> pd.DataFrame:
    rng = np.random.default_rng(5)
    x = rng.normal(size=n)
    x[rng.random(n) < 0.2] = np.nan
    day = pd.Series(pd.Timestamp("1955-03-04") + pd.to_timedelta(rng.integers(0, 30000, n), "D"))
    day[rng.random(n) < 0.1] = pd.NaT
    texts = ["", "a", "pärty ß", "x" * 30, "日本"]
    return pd.DataFrame({
        "b": rng.integers(-127, 100, n).astype("int8"), "i": rng.integers(-32767, 32740, n).astype("int16"), "l": rng.integers(-(2**31) + 1, 2147483620, n).astype("int32"),
        "f": rng.normal(size=n).astype("float32"), "x": x, "s": [texts[k] for k in rng.integers(0, 5, n)], "day": day, "at": day + pd.to_timedelta(1234, "ms"),
    })


def plain(v):
    return None if pd.isna(v) else v.isoformat() if hasattr(v, "isoformat") else float(v) if isinstance(v, (int, float, np.number)) else v


def same(got, want):
    assert got == [tuple(plain(v) for v in r) for r in want.itertuples(index=False)]


def decoded(path, names=None):
    schema = stata.StataSource({"path": path}).schema()
    reader = formats._StataReader(path, schema if names is None else type(schema)([schema[n] for n in names]))
    tz = lambda v: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return [tuple(plain(tz(v)) for v in r) for p in reader.partitions() for r in reader.read(p)]


@pytest.mark.parametrize("version", [114, 117, 118, 119])
@pytest.mark.parametrize("byteorder", ["<", ">"])
def test_all_releases(tmp_path, monkeypatch, version, byteorder):
    monkeypatch.setattr(stata, "ROWS", 70)
    monkeypatch.setattr(stata, "BATCH", 32)
    df = frame(200)
    if version < 118:
        df["s"] = df["s"].replace("日本", "é")
    path = str(tmp_path / "a.dta")
    df.to_stata(path, write_index=False, version=version, byteorder=byteorder, convert_dates={"day": "td", "at": "tc"}, variable_labels={"x": "a label"})
    same(decoded(path), pd.read_stata(path, convert_categoricals=False))
    same(decoded(path, ["s", "b"]), pd.read_stata(path, convert_categoricals=False, columns=["s", "b"]))
    assert stata.StataSource({"path": path}).schema()["x"].metadata["comment"] == "a label"


@pytest.mark.parametrize("unit", ["tw", "tm", "tq", "th", "ty"])
def test_dates(tmp_path, unit):
    path = str(tmp_path / "a.dta")
    df = pd.DataFrame({"d": pd.to_datetime(["1951-07-01", "2001-01-01", "2020-12-01"])})
    df.to_stata(path, write_index=False, convert_dates={"d": unit})
    same(decoded(path), pd.read_stata(path))


@pytest.mark.parametrize("version", [117, 118, 119])
def test_long_texts_and_extended_missing(tmp_path, version):
    path = str(tmp_path / "a.dta")
    df = pd.DataFrame({"t": ["x" * 5000, "", "short", "x" * 5000, "y" * 3000], "n": pd.array([1, 2, 3, 4, 5], "int8")})
    df.to_stata(path, write_index=False, version=version, convert_strl=["t"])
    same(decoded(path), df)
    with stata.opened(path) as f:
        h = stata.read_header(f)
    raw = bytearray(open(path, "rb").read())
    raw[h.data + 8] = 101  # the first n becomes the missing value "."
    raw[h.data + 9 + 8] = 127  # and the second ".z"
    open(path, "wb").write(raw)
    assert [r[1] for r in decoded(path)] == [None, None, 3.0, 4.0, 5.0]


def test_filters_and_columns_read_less(spark, tmp_path, monkeypatch):
    df = frame(1000)
    path = str(tmp_path / "a.dta")
    df.to_stata(path, write_index=False, version=118, convert_dates={"day": "td", "at": "tc"})
    tests = [
        ([], df.b > -200), ([("b", "=", 7)], df.b == 7), ([("x", ">", 0.5), ("s", "=", "a")], (df.x > 0.5) & (df.s == "a")), ([("b", "in", [1, 2, 3])], df.b.isin([1, 2, 3])),
        ([("b", "=", 127)], df.b == 127), ([("x", "known", None), ("i", ">=", 0)], df.x.notna() & (df.i >= 0)), ([("s", "<", "b")], df.s.map(lambda t: t.encode() < b"b")),
        ([("x", "<=", 0), ("b", "<", 0)], (df.x <= 0) & (df.b < 0)), ([("s", "in", [])], df.b > 200), ([("b", ">", 6.5)], df.b > 6.5), ([("b", "in", [6.5, 7])], df.b == 7),
    ]
    for where, want in tests:
        assert sorted(r.l for r in stata.scan(spark, path, ["l"], where).collect()) == sorted(df.l[want].tolist()), where
    whole = formats.load(spark, path)  # a DataFrame that is used again gives all of its rows
    assert whole.where("b = 7").count() == int((df.b == 7).sum()) and whole.count() == 1000
    for bad in (("no", "=", 1), ("day", "=", 1), ("b", "~", 1), ("b", "=", "x"), ("s", "=", 1), ("x", "=", float("nan"))):
        with pytest.raises(ValueError, match="no test"):
            stata.scan(spark, path, ["l"], [bad])
    cells = []
    real = stata.column
    monkeypatch.setattr(stata, "column", lambda h, name, values, *more: cells.append((name, len(values))) or real(h, name, values, *more))
    schema = stata.StataSource({"path": path}).schema()
    reader = stata.StataReader(path, type(schema)([schema["l"]]), [("b", "=", 7)])
    assert sum(b.num_rows for b in reader.batches(0, 1000)) == int((df.b == 7).sum())
    seen = {n: sum(k for m, k in cells if m == n) for n in {m for m, _ in cells}}
    assert set(seen) == {"l", "b"} and seen["l"] == int((df.b == 7).sum()) < 100


def test_empty_and_broken(spark, tmp_path):
    path = str(tmp_path / "a.dta")
    frame(3).iloc[:0].drop(columns=["day", "at"]).to_stata(path, write_index=False)
    assert formats.load(spark, path).count() == 0
    (tmp_path / "b.dta").write_bytes(b"no such file at all")
    with pytest.raises(ValueError, match="release"):
        stata.StataSource({"path": str(tmp_path / "b.dta")}).schema()
