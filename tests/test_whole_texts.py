"""The text rules read all orders, missing values among them."""

from __future__ import annotations

import pytest

from psephos.plans import registry
from tests.compare import rows, tables
from tests.whole import far_tables

RULES = ("generic_option_regex", "multiperson_flag", "role_flag", "gender_code", "bool_like")


@pytest.fixture(scope="module")
def far(data, tmp_path_factory):
    return far_tables(data, str(tmp_path_factory.mktemp("far")))


@pytest.mark.parametrize("name", RULES)
def test_all_orders(spark, far, name):
    want = registry.oracle_sql()[name].replace(" WHERE o_orderkey < 2600", "")
    assert rows(registry.queries()[name](spark, far).toPandas()) == rows(tables(far).sql(want).df())


def test_clean_and_coalesce_keeps_missing_values(spark, far):
    got = {r.id: r for r in registry.queries()["clean_and_coalesce"](spark, far).collect()}
    assert len(got) == 1500
    for k, r in got.items():
        if k % 13 in (10, 12):  # the text is 'nan', or missing
            assert (r.cleaned, r.shown, r.num) == ("", f"id {k}", None)
        else:
            assert r.cleaned != "" and r.shown == r.cleaned and r.num == (0.0 if k % 13 == 8 else None)
