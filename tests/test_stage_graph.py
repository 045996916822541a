"""Stages read their predecessors' tables and are done again when these change."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from psephos.plans.pipeline import Pipeline, Settings, Stage, survey_stages


def statuses(spark, data, settings) -> dict[str, str]:
    p = Pipeline(survey_stages(data))
    assert p.run(spark, settings) == 0, p.log()
    return {s.name: s.status for s in p.steps}


def test_changes_run_their_successors_alone(spark, data, tmp_path):
    s = Settings(str(tmp_path))
    assert set(statuses(spark, data, s).values()) == {"done"}
    read = lambda name: s.read(spark, name)
    # the chain hands over
    entity, leader, queue = read("entity"), read("leader"), read("repair_queue")
    assert leader.count() == entity.count() > queue.count() > 0 and queue.join(leader, "entity_id", "left_anti").isEmpty()
    repaired = read("leader_repaired")
    assert repaired.count() == entity.count() and repaired.where("repaired").count() > 0
    assert repaired.where("NOT repaired").select(leader.columns).exceptAll(leader).isEmpty()
    assert read("match").count() <= entity.count() and read("review").count() == read("match").count()
    applied, product = read("applied"), read("product")
    assert applied.count() == entity.count() and product.count() == read("share").count()
    assert product.join(applied.where("party IS NOT NULL").select("country", "year", "party", F.col("age").alias("a")), ["country", "year", "party"]).where("NOT age <=> a").isEmpty()
    assert read("estimate").count() == 56

    # a reviewer's entries: only what comes after review runs, and they are there after a rebuild
    marked = read("review").toPandas()
    marked["approve_apply"] = ["yes" if k % 2 else "" for k in range(len(marked))]
    spark.createDataFrame(marked, read("review").schema).write.mode("overwrite").parquet(s.path("review"))
    s.extra["apply"] = json.dumps({"manual": True})
    got = statuses(spark, data, s)
    assert {n for n, x in got.items() if x == "done"} == {"apply", "products", "estimates"}
    assert 0 < read("applied").where("ai_match_used = 1").count() <= sum(marked["approve_apply"] == "yes")

    # a patch changes the leaders, and what uses them
    one = read("leader").first().entity_id
    s.extra["patch"] = json.dumps({"patches": [[one, 99, 1]]})
    got = statuses(spark, data, s)
    assert {n for n, x in got.items() if x == "done"} == {"patch", "apply", "products", "estimates"}
    assert read("applied").where(F.col("entity_id") == one).first().age == 99

    # a changed upstream table runs just its successors
    read("match").withColumn("match_score", F.lit(95.0)).write.parquet(str(tmp_path / "other"))
    spark.read.parquet(str(tmp_path / "other")).write.mode("overwrite").parquet(s.path("match"))
    got = statuses(spark, data, s)
    assert {n for n, x in got.items() if x == "done"} == {"review", "apply", "products", "estimates"}
    assert read("review").where("approve_apply = 'yes'").count() == sum(marked["approve_apply"] == "yes")
    assert set(statuses(spark, data, s).values()) == {"reused"}
    plan = Pipeline(survey_stages(data))
    plan.run(spark, Settings(str(tmp_path), dry_run=True, extra=s.extra | {"patch": "{}"}))
    assert {x.name for x in plan.steps if x.status == "planned"} == {"patch", "apply", "products", "estimates"}


def test_graph_is_checked():
    stage = lambda name, inputs=(): Stage(name, [name], lambda spark, s: {}, inputs=list(inputs))
    assert [s.name for s in Pipeline([stage("b", ["a"]), stage("a")]).stages] == ["a", "b"]
    with pytest.raises(ValueError, match="no stage makes x"):
        Pipeline([stage("a", ["x"])])
    with pytest.raises(ValueError, match="one name"):
        Pipeline([stage("a"), stage("a")])
    with pytest.raises(ValueError):
        Pipeline([stage("a", ["b"]), stage("b", ["a"])])
