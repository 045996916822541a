"""Records, sources, requests and answers of all events, orders and customers."""

from __future__ import annotations

import re

import pytest

from psephos.plans import registry
from tests.compare import rows, tables
from tests.whole import far_tables

NAMES = ("json_tolerant_parse", "json_flatten", "json_array_aggregate", "usage_flatten", "sources_walk", "sources_merge", "request_lines", "enrichment_resume")


@pytest.fixture(scope="module")
def far(data, tmp_path_factory):
    return far_tables(data, str(tmp_path_factory.mktemp("far")))


@pytest.mark.parametrize("name", NAMES)
def test_all_rows(spark, far, name):
    want = re.sub(r" WHERE (event_id|o_orderkey) < \d+", "", registry.oracle_sql()[name]).replace("c_custkey < 300 AND ", "")
    got = rows(registry.queries()[name](spark, far).toPandas())
    assert got == rows(tables(far).sql(want).df()) and len(got) > 100
