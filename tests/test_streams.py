"""Streams with state for each target, and answers that outlive their task."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import Row

from psephos.sources import answers as A
from psephos.streaming.first_seen import keep_first, watch

SCHEMA = "target_id string, status string, n int"


def put(spark, folder, rows, name):
    (folder / name).write_text("".join(json.dumps(dict(zip(("target_id", "status", "n"), r, strict=True))) + "\n" for r in rows))


def kept(spark, out):
    return sorted((r.target_id, r.n, r.batch) for r in spark.read.parquet(str(out)).collect())


def test_first_answers_over_batches(spark, tmp_path):
    """Ties, repeated rows, missing keys, later batches, an empty batch, and a batch that is run again."""
    source, out, check = tmp_path / "in", tmp_path / "out", str(tmp_path / "check")
    source.mkdir()

    def follow():
        stream = spark.readStream.schema(SCHEMA).json(str(source)).where("status = 'ok'")
        q = keep_first(stream, ["n"], str(out), check)
        assert q.awaitTermination(90)
        assert q.exception() is None

    hot = [("hot", "ok", k) for k in range(3000, 0, -1)]
    put(spark, source, [("a", "ok", 2), ("a", "ok", 1), ("a", "ok", 1), (None, "ok", 1), ("b", "error", 1), ("c", "ok", None), ("c", "ok", 7), *hot], "1.json")
    follow()
    assert kept(spark, out) == [("a", 1, 0), ("c", 7, 0), ("hot", 1, 0)]
    put(spark, source, [("a", "ok", 0), ("b", "ok", 5), ("hot", "ok", 0)], "2.json")
    follow()
    want = [("a", 1, 0), ("b", 5, 1), ("c", 7, 0), ("hot", 1, 0)]
    assert kept(spark, out) == want
    (tmp_path / "check" / "commits" / "1").unlink()  # as if the second batch had failed after writing
    (tmp_path / "check" / "commits" / ".1.crc").unlink(missing_ok=True)
    follow()
    assert kept(spark, out) == want
    # a later batch reads nothing of what earlier ones wrote: their folders may be gone
    os.rename(out, tmp_path / "moved")
    put(spark, source, [("a", "ok", 0), ("d", "ok", 1)], "3.json")
    follow()
    assert kept(spark, out) == [("d", 1, 2)]


def test_expired_state_passes_again(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k in range(2):
        put(spark, source, [("a", "ok", k)], f"{k}.json")
        assert watch(spark, str(source), SCHEMA, str(out), str(tmp_path / "check"), expiry_hours=1e-7).awaitTermination(90)
    assert kept(spark, out) == [("a", 0, 0), ("a", 1, 1)]


def ask_and_log(log, broken=None):
    """A provider that logs what it is asked; the first time that it comes to ``broken`` its process dies."""

    def ask(request):
        target = request["target_id"]
        if target == broken and not os.path.exists(f"{log}.died"):
            open(f"{log}.died", "w").close()
            os._exit(1)
        with open(log, "a") as f:
            f.write(f"{target}\n")
        return "" if target == "t3" else '{"text": "ä\\nb"}'

    return ask


def test_killed_task_keeps_its_answers(spark, tmp_path):
    folder, log = f"file://{tmp_path}/answers", str(tmp_path / "log")
    ids = [(f"t{k}",) for k in range(40)] + [("t5",), (None,)]
    targets = spark.createDataFrame(ids, "target_id string")
    with pytest.raises(Exception):  # noqa: B017  whatever Spark reports for a worker that died
        A.collect_one_by_one(targets, ask_and_log(log, "t17"), folder, tasks=2).count()
    before = open(log).read().split()
    kept = {r.target_id for r in A.answers(spark, folder).collect()}
    assert kept == set(before) and len(before) == len(kept)
    got = {r.target_id: r.status for r in A.collect_one_by_one(targets, ask_and_log(log, "t17"), folder, tasks=3).collect()}
    assert got == {f"t{k}": "no_output_text" if k == 3 else "ok" for k in range(40)}
    asked = open(log).read().split()
    assert {t for t in asked if asked.count(t) > 1} <= {"t3"}  # only what had no good answer was asked twice
    again = A.collect_one_by_one(targets, ask_and_log(log), folder, tasks=3, every=10)
    assert again.count() == 40 and open(log).read().split() == [*asked, "t3"]


def test_attempt_that_is_run_again(tmp_path):
    """A second attempt reads the pieces of the first, pieces become one file, and a third attempt asks nothing."""
    asked = []

    def ask(request):
        asked.append(request["target_id"])
        if len(asked) == 4:
            raise KeyboardInterrupt
        return "{}"

    w = A.AnswerWriter(f"file://{tmp_path}/f", "r", ask, 1)
    rows = [Row(target_id=t) for t in ("a", "b", "b", "c", "d", "e")]
    with pytest.raises(KeyboardInterrupt):
        w.keep(iter(rows), 7, 0)
    assert asked == ["a", "b", "c", "d"]
    assert w.keep(iter(rows), 7, 1).answers == 5 and asked == ["a", "b", "c", "d", "d", "e"]
    assert [p.name for p in (tmp_path / "f" / "run=r").iterdir()] == ["part-000007.json"]
    assert w.keep(iter(rows), 7, 2).answers == 5 and len(asked) == 6
    assert w.keep(iter([]), 8, 0).answers == 0  # a task without rows leaves no file
    assert [p.name for p in (tmp_path / "f" / "run=r").iterdir()] == ["part-000007.json"]


def test_good_answers_win(spark, tmp_path):
    """The first good answer counts; where there is none, the last one."""
    lines = [("a", "error", "x", 5, 1.0), ("a", "ok", "{}", 1, 3.0), ("a", "ok", '{"later": 1}', 1, 4.0), ("b", "error", "x", 5, 1.0), ("b", "invalid_json", "y", 1, 2.0)]
    spark.createDataFrame(lines, A.LINES).write.json(f"{tmp_path}/run=1")
    assert sorted(map(tuple, A.answers(spark, str(tmp_path)).collect())) == [("a", "ok", "{}", 1), ("b", "invalid_json", "y", 1)]
