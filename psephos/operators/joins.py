"""Joins with a checked cardinality, cascades, updates and candidate lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.operators.aggregates import keep_first, unique_rows
from psephos.operators.similarity import kept_two, once, top_two, top_two_close

#: Thresholds of the fuzzy match: score, lead over the second, tolerated difference of shares, largest deduction.
ACCEPT, MARGIN, TOLERANCE, MOST_DEDUCTED = 94.0, 5.0, 1.0, 5.0


class CardinalityError(ValueError):
    """A join key is not as unique as promised."""


def assert_unique(df: DataFrame, keys: list[str], side: str) -> None:
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise CardinalityError(f"{side} side has several rows for {twice[0].asDict()}")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "m:1", null_safe: bool = True) -> DataFrame:
    """A join that first makes sure of its cardinality; missing keys match each other unless told otherwise."""
    if validate.endswith(":1"):
        assert_unique(right, keys, "right")
    if validate.startswith("1:"):
        assert_unique(left, keys, "left")
    if not null_safe:
        return left.join(right, keys, how)
    return null_safe_join(left, right, keys, how)


def unique_side(df: DataFrame, keys: list[str], side: str = "right") -> DataFrame:
    """The table with a check inside the plan: a job that meets a key twice fails with an error that names side and key.

    Nothing runs here. A count goes beside the key in one aggregation by the key, and the key itself raises where the count is not
    one, so no projection can drop the check. Columns keep their order and types.
    """
    shown = F.to_json(F.struct(*(F.col(k).cast("string").alias(k) for k in keys)), {"ignoreNullFields": "false"})
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.any_value(c).alias(c) for c in rest))
    message = F.concat(F.lit(f"{side} side has several rows for "), shown)
    first = F.when(F.col("_n") > 1, F.raise_error(message).cast(df.schema[keys[0]].dataType)).otherwise(F.col(keys[0]))
    return counted.withColumn(keys[0], first).select(*df.columns)


def guarded_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "m:1", null_safe: bool = True) -> DataFrame:
    """:func:`checked_join` without a job of its own: the check is part of the plan, and a key that is there twice fails the job
    that reads the join (CardinalityError cannot be raised from there; the message is the same)."""
    right = unique_side(right, keys, "right") if validate.endswith(":1") else right
    left = unique_side(left, keys, "left") if validate.startswith("1:") else left
    return null_safe_join(left, right, keys, how) if null_safe else left.join(right, keys, how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which missing keys match each other."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(renamed, cond, how).drop(*(f"_r_{k}" for k in keys))


def cascade_match(targets: DataFrame, pool: DataFrame, passes: list[tuple[str, list[str], list[str]]], take: list[str]) -> DataFrame:
    """Exact matches by successively weaker keys. A pass (method, target keys, pool keys) uses only pool keys that occur once;
    the first pass that finds a row wins. Adds ``match_method``, ``match_score`` and the pool's ``take`` columns."""
    out, found = targets, []
    for k, (method, left, right) in enumerate(passes):
        # pool keys may be missing on both sides here: one missing value is one key
        once = pool.groupBy(*right).agg(F.count("*").alias("_n"), *(F.min(c).alias(f"_{k}_{c}") for c in take)).where("_n = 1").drop("_n")
        once = once.withColumnsRenamed({r: f"_{k}k_{r}" for r in right}).withColumn(f"_{k}_hit", F.lit(method))
        cond = reduce(lambda a, b: a & b, (out[x].eqNullSafe(F.col(f"_{k}k_{y}")) for x, y in zip(left, right, strict=True)))
        out = out.join(once, cond, "left").drop(*(f"_{k}k_{r}" for r in right))
        found.append(f"_{k}_hit")
    method = F.coalesce(*(F.col(h) for h in found))
    picked = []
    for c in take:
        value = F.lit(None)
        for k in range(len(passes) - 1, -1, -1):
            value = F.when(F.col(found[k]).isNotNull(), F.col(f"_{k}_{c}")).otherwise(value)
        picked.append(value.alias(c))
    score = F.when(method.isNotNull(), 100.0)
    return out.select(*targets.columns, method.alias("match_method"), score.alias("match_score"), *picked)


def _best_two(own: DataFrame, other: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Of targets that close names do not decide: near shares first, then the whole block."""
    band = F.floor(F.col("_share") / TOLERANCE)
    known, unknown = own.where("_share IS NOT NULL"), other.where("_share IS NULL")
    banded = other.where("_share IS NOT NULL").withColumn("_band", F.explode(F.sequence(band - 1, band + 1)))
    near = top_two(known.withColumn("_band", band), banded, [*keys, "_band"], TOLERANCE, MOST_DEDUCTED, kind)
    near = once(kept_two(near.unionByName(top_two(known, unknown, keys, TOLERANCE, MOST_DEDUCTED, kind))))
    alone = own.join(near.select("_t").distinct(), "_t", "left_anti")
    return near.unionByName(top_two(alone, other, keys, None, MOST_DEDUCTED, kind))


def fuzzy_match(targets: DataFrame, pool: DataFrame, block: list[str], target_id: str, pool_id: str, names: tuple[str, str], share: str, kind: str = "ratio") -> DataFrame:
    """The best candidate of each target within its block, with the verdict of the margin rule.

    Candidates are those whose share is within TOLERANCE or unknown, or the whole block where there are none. The score is the
    largest of five name similarities ("ratio" of matching runs, or "edit" distance) times 100, less the difference of shares
    (MOST_DEDUCTED at most). A target is ``accepted`` if its best score reaches ACCEPT and leads the second by MARGIN. Both sides
    call their columns alike. Shares are cut into bands of TOLERANCE, and a target meets its own and the neighbouring bands first.
    """
    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        columns = [F.col(key).alias(name), *(F.col(n).alias(m) for n, m in zip(names, ("_local", "_eng"), strict=True)), F.col(share).cast("double").alias("_share")]
        return df.select(*(F.col(b).alias(f"_k{k}") for k, b in enumerate(block)), *columns)

    own, other = once(side(targets, target_id, "_t")), once(side(pool, pool_id, "_id"))  # names and shares, read several times
    keys = [f"_k{k}" for k in range(len(block))]
    close = once(top_two_close(own, other, keys, TOLERANCE, MOST_DEDUCTED, kind))
    own = once(own.join(close.select("_t").distinct(), "_t", "left_anti"))
    found = close if own.isEmpty() else close.unionByName(_best_two(own, other, keys, kind))
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "_id", "score", "_gap")))  # two at most
    first, second = F.get("_top", F.lit(0)), F.get("_top", F.lit(1))
    top = found.groupBy("_t").agg(items.alias("_top")).select(F.col("_t").alias("_t"), first["_id"].alias("best_id"), first["score"].alias("score"), second["score"].alias("second"), first["_gap"].alias("share_gap"))
    accepted = (F.col("score") >= ACCEPT) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= MARGIN))
    return targets.join(top, F.col(target_id) == F.col("_t")).select(*targets.columns, "best_id", "score", "second", "share_gap", accepted.alias("accepted"))


def ranked_candidates(pool: DataFrame, block: list[str], order: list[Column | str]) -> DataFrame:
    """The pool with each candidate's rank in its block."""
    return pool.withColumn("rank_by_share", F.row_number().over(Window.partitionBy(*block).orderBy(*order)))


def candidate_lists(ranked: DataFrame, block: list[str], fields: list[str], id_col: str, top: int = 5) -> DataFrame:
    """For each block its candidates as an array of structs in rank order, and the first ids joined by bars. The whole list is
    one row; where the first candidates are enough, :func:`top_candidates` keeps no more than those."""
    items = F.array_sort(F.collect_list(F.struct("rank_by_share", *fields)))
    out = ranked.groupBy(*block).agg(items.alias("candidates"))
    ids = F.transform(F.slice("candidates", 1, top), lambda c: c[id_col].cast("string"))
    return out.withColumn("top_ids", F.array_join(ids, "|")).withColumn("cand_json", F.to_json("candidates", {"ignoreNullFields": "false"}))


def top_candidates(pool: DataFrame, block: list[str], order: list[Column | str], fields: list[str], id_col: str, top: int = 5) -> DataFrame:
    """For each block how many candidates it has (``n``), the first ``top`` of them as :func:`candidate_lists` has them, and their
    ids joined by bars. Each task keeps the first ones of its own rows, and these alone are shuffled and ranked."""
    counts = pool.groupBy(*block).agg(F.count("*").alias("n"))
    best = ranked_candidates(pool, block, order).where(F.col("rank_by_share") <= top)
    return null_safe_join(counts, candidate_lists(best, block, fields, id_col, top), block)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to be done."""
    return todo.join(done.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` that have no successor, and all of ``new``; columns of either are kept."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def point_patch(df: DataFrame, patch: DataFrame, key: str, fallback: list[str], values: list[str]) -> DataFrame:
    """Overwrite ``values`` in rows that a patch names by key or, failing that, by the fallback columns; adds ``patched``.

    ``patch`` is a hand-written table with unique keys; only existing columns are overwritten.
    """
    have = [v for v in values if v in df.columns]
    by_key = patch.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *(F.col(v).alias(f"_a_{v}") for v in have))
    by_rest = patch.select(*(F.col(f).alias(f"_f_{f}") for f in fallback), F.lit(True).alias("_hit2"), *(F.col(v).alias(f"_b_{v}") for v in have))
    cond = reduce(lambda a, b: a & b, (df[f] == F.col(f"_f_{f}") for f in fallback))
    out = df.join(by_key, df[key] == F.col("_k"), "left").join(keep_first(by_rest, [f"_f_{f}" for f in fallback], [f"_f_{fallback[0]}"]), cond, "left")
    hit, hit2 = F.coalesce("_hit", F.lit(False)), F.coalesce("_hit2", F.lit(False))
    new = {v: F.when(hit, F.col(f"_a_{v}")).when(hit2, F.col(f"_b_{v}")).otherwise(F.col(v)) for v in have}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in df.columns), (hit | hit2).alias("patched"))


__all__ = ["CardinalityError", "assert_unique", "candidate_lists", "cascade_match", "checked_join", "fuzzy_match", "guarded_join", "null_safe_join", "point_patch", "ranked_candidates", "resume", "top_candidates", "unique_rows", "unique_side", "upsert"]
