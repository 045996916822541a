"""The survey chain: every stage reads what its predecessors wrote.

    preflight                      counts over the input tables
    backbone   -> entity, share    entities (party and election) and their shares
    collect    -> answer, leader   a provider's answers for the entities, and what they say of leaders
    repair     -> repair_queue, leader_repaired     what has to be asked again, and the better of both answers
    patch      -> leader_patched   values corrected by hand
    match      -> candidate, match the entities in an outside list: exact passes, then similarity
    review     -> review           verdicts for reviewers, whose entries survive a rebuild
    apply      -> applied          the entities with leaders (patched before repaired before collected) and matched ids
    products   -> product, agent, panel             what estimates need
    estimates  -> estimate         the supply sweep
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions import jsonx as X
from psephos.functions.nulls import clean_text
from psephos.functions.text import norm_name
from psephos.operators import econ as E
from psephos.operators import joins as J
from psephos.operators import rules as R
from psephos.operators import windows as W
from psephos.operators.aggregates import wmean
from psephos.operators.resample import weighted_resample
from psephos.plans import entities, shares
from psephos.plans.base import respondents
from psephos.plans.pipeline import Settings, Stage, prefer
from psephos.sources.resolve import exists
from psephos.streaming.collect import collect, recorded

Tables = dict[str, DataFrame]
#: What a leader table has besides the entity's id.
LEADER = ["status", "resolved", "name", "age", "male", "leaders", "multiple", "confidence"]
INSTRUMENTS = ["z1", "z2"]


def answered(spark: SparkSession, tables: str, targets: DataFrame, again: bool) -> DataFrame:
    """Targets with the record that the provider gives for them, made from the entity's first member; NULL where it gives none. A
    second request is answered for more of them and more fully."""
    k = F.conv(F.substring(F.md5("target_id"), 1, 6), 16, 10).cast("bigint")
    known = F.lit(True) if again else k % 7 != 0
    leader = F.struct(F.concat(F.lit("Leader "), "target_id").alias("full_name"), (1940 + k % 40).cast("int").alias("birth_year"), F.when(k % 3 == 0, "f").when((k % 3 == 1) | F.lit(again), "m").alias("gender_text"), F.lit(True).alias("include_in_average"))
    record = F.struct((k % 5 != 0 if not again else F.lit(True)).alias("resolved"), F.concat(F.lit("Leader "), "target_id").alias("leader_name"), F.array(leader).alias("leaders"), ((k % 100) / 100).alias("confidence"))
    return targets.withColumn("answer", F.when(known, F.to_json(record)))


def leaders(answers: DataFrame, entity: DataFrame) -> DataFrame:
    """What the answers say of each entity's leaders."""
    rows = answers.join(entity.select(F.col("entity_id").alias("target_id"), F.to_date("first_day").alias("day")), "target_id").withColumn("r", X.parse_record("raw", X.LEADER_RECORD))
    rows = X.with_leaders(rows, "r", "day").select(F.col("target_id").alias("entity_id"), "status", F.col("r.resolved").alias("resolved"), F.col("r.confidence").alias("confidence"), *X.leader_metrics(F.col("r"), F.col("who")))
    return rows.select(
        "entity_id", "status", F.col("resolved").cast("string").alias("resolved"), F.coalesce("leader_name_joined", F.lit("")).alias("name"), F.col("candidate_age").alias("age"), F.col("candidate_male1").alias("male"),
        F.col("leader_count_total").alias("leaders"), F.col("multiple_leaders").alias("multiple"), "confidence",
    )


def run_backbone(spark: SparkSession, s: Settings, tables: str) -> Tables:
    return {"entity": entities.entity_rollup(spark, tables), "share": shares.market_party_share(spark, tables)}


def run_collect(spark: SparkSession, s: Settings, tables: str) -> Tables:
    entity = s.read(spark, "entity")
    answers = collect(answered(spark, tables, entity.select(F.col("entity_id").alias("target_id")), False), recorded)
    return {"answer": answers, "leader": leaders(answers, entity)}


def run_repair(spark: SparkSession, s: Settings, tables: str) -> Tables:
    leader, entity = s.read(spark, "leader"), s.read(spark, "entity")
    needs = R.repair_needs(*(F.col(c) for c in ("status", "resolved", "age", "male", "confidence")))
    mode = R.repair_mode(F.col("resolved"), F.col("name"), F.col("multiple").cast("string"), F.lit(None).cast("string"), F.col("leaders"))
    queue = leader.select("entity_id", R.told(needs).alias("reason"), mode.alias("mode")).where("reason <> ''")
    again = collect(answered(spark, tables, queue.select(F.col("entity_id").alias("target_id")), True), recorded)
    new = leaders(again, entity).withColumnsRenamed({c: f"n_{c}" for c in LEADER})
    both = leader.join(new, "entity_id", "left")
    old, fresh = {c: F.col(c) for c in LEADER}, {c: F.col(f"n_{c}") for c in LEADER}
    better = F.coalesce(R.is_improvement(old, fresh), F.lit(False)) & F.col("n_status").isNotNull()
    return {"repair_queue": queue, "leader_repaired": both.select("entity_id", *(F.when(better, fresh[c]).otherwise(old[c]).alias(c) for c in LEADER), better.alias("repaired"))}


def run_patch(spark: SparkSession, s: Settings, tables: str) -> Tables:
    """Patches name an entity; they come as (entity_id, age, male) in the parameter ``patches``."""
    rows = s.read(spark, "leader_repaired")
    patch = spark.createDataFrame([(p[0], p[0], float(p[1]), float(p[2])) for p in s.parameters("patch").get("patches", [])], "entity_id string, also string, age double, male double")
    out = J.point_patch(rows.withColumn("also", F.lit(None).cast("string")), patch, "entity_id", ["also"], ["age", "male"])
    return {"leader_patched": out.drop("also")}


def run_match(spark: SparkSession, s: Settings, tables: str) -> Tables:
    entity = s.read(spark, "entity").select("entity_id", "country", "year", F.coalesce(norm_name("first_name"), F.lit("")).alias("eng"), F.lit("").alias("loc"), F.round(F.col("weight") / 1000, 3).alias("share"))
    outside = entities.match_sides(spark, tables)[1]
    candidate = J.top_candidates(outside, ["country", "year"], [F.col("share").desc_nulls_last(), F.col("old_id")], ["old_id", "eng", "share"], "old_id")
    exact = J.cascade_match(entity, outside, [p for p in entities.PASSES if "loc" not in p[1]], ["old_id"])
    found = exact.where("old_id IS NOT NULL").select("entity_id", "old_id", "match_method", "match_score", F.lit(True).alias("accepted"))
    rest = J.fuzzy_match(exact.where("old_id IS NULL").select(*entity.columns), outside, ["country", "year"], "entity_id", "old_id", ("loc", "eng"), "share")
    rest = rest.select("entity_id", F.col("best_id").alias("old_id"), F.lit("similarity").alias("match_method"), F.col("score").alias("match_score"), "accepted")
    return {"candidate": candidate, "match": found.unionByName(rest)}


def run_review(spark: SparkSession, s: Settings, tables: str) -> Tables:
    bucket = F.when(F.col("accepted"), "strong_candidate").when(F.col("match_score") >= 80, "check").otherwise("weak")
    rows = s.read(spark, "match").select("entity_id", "old_id", F.greatest(F.lit(0), F.floor("match_score")).cast("int").alias("trust"), bucket.alias("bucket"))
    own = s.path("review")
    return {"review": R.with_approvals(rows, spark.read.parquet(own) if exists(spark, own) else None, "entity_id")}


def run_apply(spark: SparkSession, s: Settings, tables: str) -> Tables:
    entity, review = s.read(spark, "entity"), s.read(spark, "review")
    leader = spark.read.parquet(prefer(spark, s, ["leader_patched", "leader_repaired", "leader"]))
    approved = R.may_apply(F.col("approve_apply"), F.col("bucket"), F.col("trust"), manual=bool(s.parameters("apply").get("manual")))
    ids = review.where(approved).select("entity_id", F.col("old_id").alias("proposed"))
    rows = J.guarded_join(entity, leader.select("entity_id", "name", "age", "male"), ["entity_id"])
    rows = J.guarded_join(rows, ids, ["entity_id"])
    return {"applied": rows.select("entity_id", "country", "year", "party", clean_text("name").alias("leader"), "age", "male", *R.never_overwrite(F.lit(None).cast(ids.schema["proposed"].dataType), F.col("proposed")))}


def run_products(spark: SparkSession, s: Settings, tables: str) -> Tables:
    share, applied = s.read(spark, "share"), s.read(spark, "applied").where("party IS NOT NULL").select("country", "year", "party", "age", "male", "final_id")
    index = shares.indexed(spark, tables).select("market", "year", "country", "party", "idx", "x2", "family")
    product = J.guarded_join(share, index, ["market", "year", "party"])
    product = J.guarded_join(product, applied, ["country", "year", "party"]).withColumnRenamed("idx", "econ").withColumnRenamed("x2", "cult")
    people = respondents(spark, tables).join(share.select("market").distinct(), "market", "left_semi")
    agent = weighted_resample(people.select("market", "rid", "w", "x2"), "market", "rid", "w")
    z = product.groupBy("country", "year").agg(F.avg("age").alias("z1"), F.avg("male").alias("z2"))
    panel = product.groupBy("country", "year", "party").agg(wmean("econ", "share").alias("econ"), wmean("cult", "share").alias("cult"), F.max("share").alias("d"))
    panel = panel.join(z, ["country", "year"]).withColumn("party", F.concat_ws("|", "country", F.col("party").cast("string")))
    return {"product": product, "agent": agent, "panel": panel}


def run_estimates(spark: SparkSession, s: Settings, tables: str) -> Tables:
    panel = s.read(spark, "panel")
    dims = {}
    for dim in ("econ", "cult"):
        rows = panel.withColumn("x", F.col(dim)).withColumns({"lagx": W.previous("x", "party", ["year"]), "fam": W.leave_one_out("x", ["country", "year"])})
        dims[dim] = rows.select("party", "year", "x", "d", "lagx", "fam", *INSTRUMENTS)
    large = {k: p.withColumn("_keep", W.ever_reaches("d", ["party"], float(s.parameters("estimates").get("threshold", 0.12)))).where("_keep").drop("_keep") for k, p in dims.items()}
    return {"estimate": spark.createDataFrame(E.sweep({"all": dims, "ever_large": large}, INSTRUMENTS))}


def survey_stages(tables: str) -> list[Stage]:
    """The whole chain on the tables under ``tables``."""

    def stage(name: str, run, outputs: list[str], inputs: list[str], sources: bool = False, **more) -> Stage:
        return Stage(name, outputs, lambda spark, s: run(spark, s, tables), inputs=inputs, sources=[tables] if sources else [], **more)

    return [
        stage("preflight", lambda spark, s, t: {"preflight": entities.preflight_report(spark, t)}, ["preflight"], [], sources=True, optional=True),
        stage("backbone", run_backbone, ["entity", "share"], [], sources=True),
        stage("collect", run_collect, ["answer", "leader"], ["entity"]),
        stage("repair", run_repair, ["repair_queue", "leader_repaired"], ["leader", "entity"]),
        stage("patch", run_patch, ["leader_patched"], ["leader_repaired"]),
        stage("match", run_match, ["candidate", "match"], ["entity"], sources=True),
        stage("review", run_review, ["review"], ["match"]),
        stage("apply", run_apply, ["applied"], ["entity", "review", "leader_patched", "leader_repaired", "leader"]),
        stage("products", run_products, ["product", "agent", "panel"], ["share", "applied"], sources=True),
        stage("estimates", run_estimates, ["estimate"], ["panel"]),
    ]
