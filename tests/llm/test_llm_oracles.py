"""Every oracle of the training-data queries at the smallest scale, and every query's rows per document."""

import pytest

from tagloom.llm import queries
from tests.compare import check
from tests.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, duck, name):
    assert isinstance(queries.ORACLES[name], str)
    result = check(queries.QUERIES[name](spark, SF_DIR), queries.ORACLES[name], duck)
    assert result.startswith("ok"), result


def test_all_thirteen_are_registered():
    assert [sum(n.startswith(f"op{i}_") for n in queries.QUERIES) for i in range(1, 14)] == [1] * 13
