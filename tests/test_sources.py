"""Readers, writers, resolvers and the stage pipeline."""

from __future__ import annotations

import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from psephos.plans.pipeline import Pipeline, Settings, Stage, prefer, survey_stages
from psephos.sources import archives, formats, resolve, sinks


def test_stata(spark, tmp_path):
    path = str(tmp_path / "a.dta")
    pd.DataFrame({"x": [1.5, None], "n": [1, 2], "s": ["a", ""], "t": pd.to_datetime(["2001-02-03", None])}).to_stata(path, write_index=False, version=118, variable_labels={"x": "a label"})
    df = formats.load(spark, path)
    assert df.schema["x"].metadata["comment"] == "a label" and df.count() == 2
    assert [r.x for r in df.orderBy("n").collect()] == [1.5, None] and df.select("n").orderBy("n").first().n == 1


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>sign econ</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>-1</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>code</t></si><si><t>per101 text</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    df = formats.load(spark, path)
    assert df.columns == ["code", "column_2", "sign econ"] and tuple(df.first()) == ("per101 text", None, "-1")
    assert resolve.pick_code_column(df) == "code" and resolve.pick_sign_column(df, "econ") == "sign econ"


def test_workbook_order(spark, tmp_path):
    """The first sheet is the first that the workbook lists, whatever its file is called; runs and phonetic readings, empty rows."""
    path, ns = str(tmp_path / "a.xlsx"), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c></row>' for k in range(2, 500))
    links = {"rId1": "worksheets/sheet1.xml", "rId2": "/xl/worksheets/sheet10.xml", "rId3": "chartsheets/sheet1.xml"}
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{r}"><sheets><sheet name="c" r:id="rId3"/><sheet name="x" r:id="rId2"/><sheet name="y" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in links.items()) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><r><t>na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>wrong</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet10.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row>{rows}</sheetData></worksheet>')
        z.writestr("xl/chartsheets/sheet1.xml", f"<chartsheet {ns}/>")
    df = formats.load(spark, path)
    assert df.columns == ["name"] and [r.name for r in df.collect()] == [str(k) for k in range(2, 500)]
    bare = str(tmp_path / "b.xlsx")
    with zipfile.ZipFile(bare, "w") as z:
        for k in (10, 2):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>s{k}</v></c></row></sheetData></worksheet>')
    assert formats.load(spark, bare).columns == ["s2"] and formats.load(spark, bare).count() == 0


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,d\n"x ""y""\nz",2001-01-01\n')
    row = formats.load(spark, str(tmp_path / "a.csv"), dates=("d", "none")).first()
    assert row.a == 'x "y"\nz' and row.d.year == 2001
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert formats.load_first(spark, [str(tmp_path / "no.csv"), str(tmp_path / "a.jsonl")]).count() == 2


def test_archives(tmp_path):
    path, content = tmp_path / "a.zip", b"content" * 1000
    for method in (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED):
        with zipfile.ZipFile(path, "w", method) as z:
            z.writestr("d/x.dta", content)
        assert archives.extract_single(path, tmp_path / "out").read_bytes() == content
        broken = tmp_path / "b.zip"
        broken.write_bytes(path.read_bytes()[:-60])
        assert archives.extract_single(broken, tmp_path / f"out{method}").read_bytes() == content
    assert (archives.extract_all(path, tmp_path / "all") / "d/x.dta").exists()


def test_resolver(spark):
    df = spark.createDataFrame([(1, "2", 3.0)], "Age int, per101 string, per102 double")
    assert resolve.first_column(df, ["age"], any_case=True) == "Age" and resolve.first_column(df, ["age"]) is None
    got = resolve.harmonised(df, {"a": (["x", "Age"], "double"), "b": (["y"], "string")})
    assert tuple(got.first()) == (1.0, None)
    assert resolve.family(df, r"^per\d+") == ["per101", "per102"] == resolve.between(df, "per101", "per102")
    assert resolve.front(df, ["per102"]).columns == ["per102", "Age", "per101"] and resolve.keep_present(df, ["q", "Age"]).columns == ["Age"]
    with pytest.raises(ValueError, match="missing"):
        resolve.require(df, ["q"])
    with pytest.raises(FileNotFoundError):
        resolve.first_path(["/nowhere/a"])


def test_stata_in_parts(spark, tmp_path, monkeypatch):
    """Each partition seeks its own rows."""
    import pandas as pd

    path = str(tmp_path / "parts.dta")
    pd.DataFrame({"n": range(1000), "s": [f"v{k}" for k in range(1000)]}).to_stata(path, write_index=False, version=118)
    reader = formats._StataReader(path, formats.StataSource({"path": path}).schema())
    got = [r for a in range(0, 1000, 130) for r in reader.read(formats._Rows(a, min(a + 130, 1000)))]
    assert got == [(k, f"v{k}") for k in range(1000)]


def test_stata_names():
    names = sinks.stata_names(["ok", "a b", "a_b", "1x", "int", "x" * 40, "x" * 33])
    assert names == {"a b": "a_b", "a_b": "a_b_1", "1x": "v_1x", "int": "int_", "x" * 40: "x" * 32, "x" * 33: "x" * 30 + "_1"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "5", None, True), (2, None, "t", False)], "n int, s string, t string, b boolean")
    kinds = dict(sinks.stage_types(df).dtypes)
    assert kinds == {"n": "double", "s": "double", "t": "string", "b": "double"}
    assert [r.t for r in sinks.stage_types(df).orderBy("n").collect()] == ["", "t"]
    sinks.write_stage(df.withColumnRenamed("t", "a b"), str(tmp_path / "s"), {"n": "a number"}, csv=True)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.schema["n"].metadata["comment"] == "a number" and "a_b" in back.columns
    sinks.append_jsonl(df, str(tmp_path / "l"))
    sinks.append_jsonl(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    sinks.write_requests(df, "n", F.struct("s"), str(tmp_path / "r"))
    assert '"custom_id":1' in spark.read.text(str(tmp_path / "r")).orderBy("value").first().value
    sinks.write_stata(df.select("n", "s"), str(tmp_path / "x.dta"))
    assert formats.load(spark, str(tmp_path / "x.dta")).count() == 2
    names = sinks.write_stata(df.withColumnRenamed("t", "a b"), str(tmp_path / "y.dta"), labels={"n": "a number", "a b": "x" * 100})
    import pandas as pd

    with pd.read_stata(tmp_path / "y.dta", iterator=True) as r:
        assert names == {"a b": "a_b"} and r.variable_labels() == {"n": "a number", "s": "", "a_b": "x" * 80, "b": ""}
    assert sinks.write_pair(df, str(tmp_path / "pair"), {"s": "numbers"}) == ""
    assert spark.read.option("header", True).csv(str(tmp_path / "pair.csv")).count() == 2 == formats.load(spark, str(tmp_path / "pair.dta")).count()
    (tmp_path / "bad.dta").mkdir()
    assert "IsADirectoryError" in sinks.write_pair(df, str(tmp_path / "bad")) and spark.read.option("header", True).csv(str(tmp_path / "bad.csv")).count() == 2
    assert sinks.patched_path("/a/b.dta").name == "b_patched.dta"


def test_pipeline(spark, data, tmp_path):
    s = Settings(str(tmp_path))
    first = Pipeline(survey_stages(data))
    assert first.run(spark, s) == 0 and [x.status for x in first.steps] == ["done"] * 10
    second = Pipeline(survey_stages(data))
    second.run(spark, s)
    assert [x.status for x in second.steps] == ["reused"] * 10
    assert prefer(spark, s, ["none", "share"]).endswith("share.parquet")

    def broken(spark, settings):
        raise RuntimeError("no")

    bad = Pipeline([Stage("a", ["a"], broken, optional=True), Stage("b", ["b"], broken), Stage("c", ["c"], broken)])
    assert bad.run(spark, s) == 1 and [x.status for x in bad.steps] == ["failed", "failed"]
    plan = Pipeline(survey_stages(data))
    plan.run(spark, Settings(str(tmp_path / "new"), dry_run=True, skip=["collect"]))
    assert [x.status for x in plan.steps] == ["planned", "planned", "skipped"] + ["planned"] * 7
    plan.write_log(tmp_path / "log.json")
    assert "planned" in (tmp_path / "log.json").read_text()
