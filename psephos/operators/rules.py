"""Ordered rules as single column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.functions.nulls import clean_text, first_text, truthy
from psephos.functions.text import bool_like, contains_any

#: Kinds of evidence for a match that may be accepted without review; fixed values.
DIRECT = ("exact_name", "abbreviation", "translation", "transliteration")
EXACTISH, TRANSLATED = DIRECT[:2], DIRECT[2:]
COMPLEX = ("alliance_or_joint_list", "merger_or_renaming")
NEGATIVE = ("generic_nonparty_option", "insufficient_evidence", "no_clear_party_match")
#: Wordings that say that the right party is not among the candidates; fixed values.
ABSENT_MARKERS = (
    "absent from the allowed candidate list", "absent from the provided mpd candidate list", "absent from the candidate list",
    "absent from the allowed mpd candidate list", "not present among the candidate mpd entries", "not present among the candidate mpd options",
    "not present in the allowed mpd candidate list", "not present among the provided candidates", "none of the allowed mpd candidates",
    "no candidate mpd option", "no corresponding mpd option", "no corresponding mpd candidate", "not in the candidate list",
    "candidate list includes other parties only", "only a component party appears", "component party rather than the full joint electoral list",
    "regional alliance/list that is not present among the candidate", "correct mpd party is absent", "true party is absent",
    "absent from the provided candidates",
)
LOW_CONFIDENCE = 0.85


def old_quality(age: Column, several: Column, unclear: Column, source: Column) -> Column:
    """What a hand-coded row is worth."""
    return (
        F.when(age.isNull(), "missing_old_data").when(several | unclear, "ambiguous_old_data").when(source == "both_inconsistent", "inconsistent_old_data")
        .otherwise("clean_old_data")
    )


def queue_reason(old_id: Column, quality: Column) -> Column:
    q = clean_text(quality)
    return (
        F.when(old_id.isNull(), "collect_missing_old_data").when(q == "clean_old_data", "audit_old_clean_single_person")
        .when(q == "ambiguous_old_data", "audit_old_ambiguous_or_multiperson").when(q == "inconsistent_old_data", "audit_old_internally_inconsistent")
        .otherwise("audit_old_other")
    )


def final_status(resolved: Column, has_new: Column, has_old: Column, quality: Column, age: Column, gender: Column, collective: Column, multiple: Column) -> Column:
    """What becomes of old and new data; an unknown ``resolved`` counts as resolved."""
    is_resolved = F.coalesce(resolved, F.lit(True))
    clean = clean_text(quality) == "clean_old_data"
    agree = age.isin("exact_match", "off_by_one", "old_missing", "ai_missing", "both_missing") & gender.isin("match", "old_missing", "ai_missing", "both_missing")
    return (
        F.when(is_resolved & truthy(collective) & ~has_new, "manual_review_collective_leadership")
        .when(is_resolved & has_new & truthy(multiple), "ai_resolved_multiple_leader_case")
        .when(is_resolved & has_new & agree & clean, "ai_confirmed_or_extended_old")
        .when(is_resolved & has_new & agree & has_old, "ai_resolved_old_problematic_row")
        .when(is_resolved & has_new & agree, "new_ai_collected")
        .when(is_resolved & has_new, "manual_review_conflict")
        .when(has_old & clean, "keep_old_unverified").when(has_old, "keep_old_but_flag_for_review").when(has_new, "new_ai_collected").otherwise("unresolved")
    )


def repair_needs(status: Column, resolved: Column, age: Column, male: Column, confidence: Column, low: float = LOW_CONFIDENCE) -> dict[str, Column]:
    """Reasons for which a record has to be collected again, in the order in which they are told."""
    return {
        "status": F.coalesce(status != "ok", F.lit(True)), "unresolved": ~truthy(bool_like(resolved)), "missing_age": age.isNull(),
        "missing_gender": male.isNull(), "low_conf": truthy(confidence < low),
    }


def told(reasons: dict[str, Column], separator: str = "|") -> Column:
    """The names of the reasons that hold."""
    return F.concat_ws(separator, *(F.when(c, n) for n, c in reasons.items()))


def repair_mode(resolved: Column, name: Column, multiple: Column, collective: Column, leaders: Column) -> Column:
    many = truthy(bool_like(multiple)) | truthy(bool_like(collective)) | (F.coalesce(leaders, F.lit(0)) > 1)
    return (
        F.when(~truthy(bool_like(resolved)), "full_resolution").when(many, "repair_leaders_array").when(clean_text(name) != "", "repair_fixed_single_leader")
        .otherwise("full_resolution")
    )


def is_improvement(old: dict[str, Column], new: dict[str, Column], more_confident: float = 0.15) -> Column:
    """Whether a repaired record is better; both sides give status, resolved, age, male, name, leaders, confidence."""

    def named(x: dict[str, Column]) -> Column:
        return (clean_text(x["name"]) != "") | (F.coalesce(x["leaders"], F.lit(0)) > 0)

    was, now = truthy(bool_like(old["resolved"])), truthy(bool_like(new["resolved"]))
    gained = (
        ((clean_text(old["status"]) != "ok") & (clean_text(new["status"]) == "ok")) | (~was & now) | (old["age"].isNull() & new["age"].isNotNull())
        | (old["male"].isNull() & new["male"].isNotNull()) | (~named(old) & named(new))
    )
    surer = ~was & ~now & named(new) & (~named(old) | truthy(new["confidence"] > old["confidence"] + more_confident))
    return gained | surer


def skip_reason(missing: Column, low_value: Column, generic: Column) -> Column:
    """Why a target is not asked for, the first reason that holds; empty if it is."""
    return (
        F.when(truthy(missing), "missing_display_name").when(truthy(low_value), "low_value_ballot_option").when(truthy(generic), "generic_nonparty_option").otherwise("")
    )


def nonmatch_reason(explicit: Column, resolved: Column, generic: Column, status: Column, texts: list[Column]) -> Column:
    text = F.lower(F.concat_ws(" | ", *(F.nullif(clean_text(t), F.lit("")) for t in texts)))
    s = clean_text(status)
    return (
        F.when(clean_text(explicit) != "", clean_text(explicit)).when(truthy(resolved), "not_applicable")
        .when(truthy(generic) | (s == "generic_nonparty_option"), "generic_nonparty_option").when(s == "insufficient_evidence", s)
        .when(contains_any(text, ABSENT_MARKERS), "candidate_absent_from_allowed_list").when(s != "", s).otherwise("no_clear_party_match")
    )


def absent_party(explicit: Column, reason: Column, names: list[Column]) -> Column:
    """The party meant where it is not among the candidates."""
    return F.when(clean_text(explicit) != "", clean_text(explicit)).when(reason == "candidate_absent_from_allowed_list", first_text(*names)).otherwise("")


def trust_rules(x: dict[str, Column]) -> list[tuple[Column, int, str]]:
    """(condition, cap, flag) in order. ``x`` has generic, n, domains, non_wiki, independent, independent_domains, reference (official
    or reference sources), high, high_domains, party_official, basis, score, rank and calls."""
    n, basis, score, ref, rank = x["n"], x["basis"], x["score"], x["reference"], x["rank"]
    exact, trans, hint, hard = basis.isin(*EXACTISH), basis.isin(*TRANSLATED), basis == "partyfacts_hint", basis.isin(*COMPLEX)
    other = ~(exact | trans | hint | hard)
    direct, far = basis.isin(*DIRECT), hint | hard
    low = score.isNull()
    return [
        (x["generic"], 25, "generic_option_flagged"),
        (n == 0, 55, "no_sources"), (n == 1, 72, "only_one_source"), ((n >= 2) & (x["domains"] <= 1), 88, "single_domain_source_set"),
        ((n > 0) & (x["non_wiki"] <= 0), 72, "only_wiki_sources"),
        ((n > 0) & (x["non_wiki"] > 0) & (x["independent"] <= 0), 82, "no_independent_nonwiki_source"),
        ((n > 0) & (x["non_wiki"] > 0) & (x["independent"] > 0) & (ref <= 0), 84, "no_official_or_reference_source"),
        ((x["party_official"] > 0) & (ref <= 0), 78, "only_party_official_support_without_independent_reference"),
        (exact & low, 88, "missing_name_similarity"), (exact & (score < 0.35), 82, "low_name_similarity_for_exactish_match"),
        (exact & (score >= 0.35) & (score < 0.60), 92, "moderate_name_similarity_for_exactish_match"),
        (trans & low, 85, "missing_name_similarity"), (trans & (score < 0.20), 74, "very_low_name_similarity_for_translation_match"),
        (trans & (score >= 0.20) & (score < 0.40), 84, "low_name_similarity_for_translation_match"),
        (trans & (ref <= 0), 86, "translation_match_without_reference_source"),
        (trans & (x["high"] < 2) & (x["independent"] < 2), 89, "translation_match_without_two_independent_nonwiki_sources"),
        (hint, 88, "partyfacts_hint_needs_independent_check"), (hint & (low | (score < 0.55)), 82, "partyfacts_hint_with_weak_name_similarity"),
        (hint & (ref <= 0), 78, "partyfacts_hint_without_reference_source"),
        (hard, 88, "structurally_complex_match"), (hard & (ref <= 0), 80, "complex_match_without_reference_source"),
        (hard & (score < 0.35), 72, "complex_match_with_weak_name_similarity"),
        (other & low, 80, "missing_name_similarity"), (other & (score < 0.30), 70, "very_low_name_similarity"),
        (other & (score >= 0.30) & (score < 0.45), 78, "low_name_similarity"),
        (direct & (ref >= 1) & (x["independent"] < 2), 89, "not_enough_independent_nonwiki_verification_for_auto"),
        (direct & (x["high"] >= 2) & (x["high_domains"] < 2), 93, "high_grade_sources_not_cross_domain"),
        (direct & (x["independent"] >= 2) & (x["independent_domains"] < 2), 91, "independent_nonwiki_sources_not_cross_domain"),
        (far & (rank > 15), 86, "candidate_far_down_share_ranking"), (far & (rank > 10) & (rank <= 15), 92, "candidate_outside_top10_by_share"),
        (~far & (rank > 20), 88, "candidate_far_down_share_ranking"), (~far & (rank > 12) & (rank <= 20), 94, "candidate_outside_top12_by_share"),
        ((x["calls"] <= 0) & (n <= 0), 50, "no_external_verification"),
    ]


def trust_cap(x: dict[str, Column], resolved: Column, status: Column, allowed: Column, from_list: Column) -> Column:
    """struct(cap, flags): the least cap of all rules that hold, and their flags."""
    rules = trust_rules(x)
    cap = F.least(F.lit(100), *(F.when(truthy(c), F.lit(v)).otherwise(100) for c, v, _ in rules))
    flags = F.concat_ws("; ", *(F.when(truthy(c), F.lit(f)) for c, _, f in rules))
    shut = (
        F.when(~truthy(resolved) | truthy(status.isin(*NEGATIVE)), "no_positive_match").when(~truthy(allowed), "selected_candidate_not_in_allowed_list")
        .when(~truthy(from_list), "selected_from_candidate_list_false")
    )
    return F.struct(F.when(shut.isNotNull(), 0).otherwise(cap).alias("cap"), F.coalesce(shut, flags).alias("flags"))


def trust_score(resolved: Column, confidence: Column, cap: Column) -> Column:
    return F.when(truthy(resolved), F.least(F.coalesce(confidence, F.lit(0)), F.coalesce(cap, F.lit(0)))).otherwise(0).cast("int")


def review_bucket(resolved: Column, reason: Column, allowed: Column, trust: Column, x: dict[str, Column]) -> Column:
    strong = ((x["reference"] >= 2) & (x["high_domains"] >= 2)) | ((x["reference"] >= 1) & (x["independent"] >= 2) & (x["independent_domains"] >= 2))
    return (
        F.when(~truthy(resolved) & (reason == "candidate_absent_from_allowed_list"), reason).when(~truthy(resolved), "no_match")
        .when(truthy(allowed) & (trust >= 90) & (x["n"] >= 2) & x["basis"].isin(*DIRECT) & strong, "strong_candidate")
        .when(truthy(allowed) & (trust >= 70), "needs_manual_review").otherwise("hold_back")
    )


def recommended_action(bucket: Column) -> Column:
    return (
        F.when(bucket == "strong_candidate", "can_apply_if_you_agree").when(bucket == "needs_manual_review", "review_manually_before_apply")
        .when(bucket == "candidate_absent_from_allowed_list", "keep_unmatched_candidate_absent_from_allowed_list").when(bucket == "no_match", "keep_unmatched")
        .otherwise("hold_back")
    )


def trust_note(resolved: Column, reason: Column, absent: Column, x: dict[str, Column], alert: Column, flags: Column) -> Column:
    """A sentence for the reviewer; the sentences and words are fixed values."""
    gone = F.when(clean_text(absent) != "", F.concat(F.lit("No positive match; identifiable party/list appears absent from the allowed MPD candidates: "), absent, F.lit(".")))
    gone = gone.otherwise("No positive match; identifiable party/list appears absent from the allowed MPD candidates.")
    counts = (("n", "source(s)"), ("domains", "domain(s)"), ("high", "official/reference source(s)"), ("independent", "independent non-wiki source(s)"), ("party_official", "official party source(s)"))
    parts = [F.when(x[k] > 0, F.concat(x[k].cast("string"), F.lit(f" {what}"))) for k, what in counts]
    parts += [F.when(clean_text(alert) != "", F.concat(F.lit("share-gap alert: "), alert)), F.when(clean_text(flags) != "", F.concat(F.lit("flags: "), flags))]
    return F.when(truthy(resolved), F.concat_ws("; ", *parts)).when(reason == "candidate_absent_from_allowed_list", gone).otherwise("No positive match; left unmatched.")


def may_apply(approved: Column, bucket: Column, trust: Column, manual: bool, least: int = 90) -> Column:
    """With manual approval only what a reviewer approved; otherwise strong candidates of enough trust."""
    if manual:
        return F.lower(clean_text(approved)).isin("1", "true", "yes", "y", "x")
    return (bucket == "strong_candidate") & (trust >= least)


def never_overwrite(validated: Column, proposed: Column) -> list[Column]:
    """The id to use, where it comes from, and whether the proposal was used: a validated id always stays."""
    used = validated.isNull() & proposed.isNotNull()
    source = F.when(validated.isNotNull(), "validated").when(used, "ai_match").otherwise("")
    return [F.coalesce(validated, proposed).alias("final_id"), source.alias("match_source"), used.cast("int").alias("ai_match_used")]


def with_approvals(review: DataFrame, old: DataFrame | None, key: str) -> DataFrame:
    """A review with the reviewers' columns of an earlier one; empty where there is none."""
    names = ("approve_apply", "reviewer_note")
    if old is None:
        return review.withColumns({n: F.lit("") for n in names})
    kept = old.select(key, *(F.col(n) for n in names if n in old.columns)).dropDuplicates([key])
    out = review.drop(*names).join(kept, key, "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit("")) if n in out.columns else F.lit("") for n in names})
