"""Every registered query runs; those with SQL give what DuckDB gives."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from psephos.plans import registry
from tests.compare import rows, tables

NAMES = sorted(registry_names := (registry._load() or registry.queries()))
ONLY_ROWS = sorted(set(registry_names) - set(registry.oracle_sql()))


@pytest.fixture(scope="module")
def duck(data):
    return tables(data)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ONLY_ROWS])
def test_same_as_sql(spark, data, duck, name):
    got = registry.queries()[name](spark, data).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in ONLY_ROWS if n not in ("demand_random_coefficients", "spec_sweep")])
def test_rows(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["market", "year", "party", "weight", "share"] and df.count() > 0


def test_registered_names_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) <= set(entry.queries())
