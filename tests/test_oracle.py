"""Every registered query against its DuckDB restatement (the driver's gate)."""

import pytest

import __spark_entry__ as E
from relmine.plans import catalog
from tests.oracle_harness import compare, duck_connect

ORACLE = catalog.ORACLE


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck_connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, sf_dir, name):
    r = compare(spark, con, name, catalog.QUERIES[name], ORACLE[name], sf_dir)
    assert r["ok"] and not r["type_diff"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "faithfulness_score" in df.columns


def test_every_query_has_sql_and_is_registered():
    assert set(catalog.QUERIES) == set(ORACLE)
    assert set(catalog.QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())
