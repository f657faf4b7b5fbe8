"""Every registered query against its DuckDB oracle at the smallest scale."""

import pytest

import catalog
from catalog.dialect import oracle, view
from catalog.fixtures import VIEWS
from tests.compare import check
from tests.conftest import SF_DIR

QUERIES, ORACLES = catalog.queries(), catalog.oracles()
# chains operators that have oracles of their own; its tree is checked in test_scale_rules.py
WITHOUT_ORACLE = {"repair_sequence"}


def test_queries_and_oracles_belong_together():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_ORACLE and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_views_agree(spark, duck, name):
    assert check(view(spark, SF_DIR, name), oracle([name], f"SELECT * FROM fx_{name}"), duck).startswith("ok")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    result = check(QUERIES[name](spark, SF_DIR), ORACLES[name], duck)
    assert result.startswith("ok"), result
