"""Targets, pools, candidates, aliases and keys of all suppliers."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pytest

from psephos.plans import entities, registry
from tests.compare import rows, tables
from tests.whole import far_tables


@pytest.fixture(scope="module")
def far(data, tmp_path_factory):
    return far_tables(data, str(tmp_path_factory.mktemp("far")))


@pytest.mark.parametrize("name", ["cascade_exact_match", "fuzzy_block_match_edit", "candidate_rank_topk", "candidate_json", "alias_lists", "stable_key_ids"])
def test_all_suppliers(spark, far, name):
    want = re.sub(r" WHERE suppkey < \d+", "", registry.oracle_sql()[name])
    assert rows(registry.queries()[name](spark, far).toPandas()) == rows(tables(far).sql(want).df())


def test_fuzzy_block_match_against_brute_force(spark, far):
    t, old = (x.toPandas() for x in entities.match_sides(spark, far))
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    pool = {k: list(g.itertuples()) for k, g in old.rename(columns={"loc": "local"}).groupby(["country", "year"])}
    want = {}
    for r in t.rename(columns={"loc": "local"}).itertuples():
        others = pool.get((r.country, r.year), [])
        near = [o for o in others if abs(r.share - o.share) <= 1.0] or others
        scored = []
        for o in near:
            a, b = f"{r.local} {r.eng}".strip(), f"{o.local} {o.eng}".strip()
            name = max(ratio(r.local, o.local), ratio(r.eng, o.eng), ratio(a, b), ratio(r.local, o.eng), ratio(r.eng, o.local))
            scored.append((-(name * 100 - min(abs(r.share - o.share), 5.0)), o.old_id))
        if scored:
            want[r.country, r.year, r.id] = (sorted(scored)[0][1], round(-sorted(scored)[0][0], 4))
    got = {(r.country, r.year, r.id): (r.best_id, round(r.score, 4)) for r in registry.queries()["fuzzy_block_match"](spark, far).collect()}
    assert got == want and len({k[2] for k in want}) == 10
