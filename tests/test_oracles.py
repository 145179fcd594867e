from __future__ import annotations

import pytest

from docloom.jobs import corpus, knowledge, more, upkeep, writing  # noqa: F401
from docloom.jobs.registry import ORACLES, QUERIES
from tests.compare import rows
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
