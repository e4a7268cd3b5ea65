"""Every registered query outside the training-data operators against its SQL, at the smallest scale."""

import pytest

from .compare import connect, differences
from .conftest import SMALL

from docloom.plans import compositions, graphs, stateful  # noqa: F401  they register their queries
from docloom.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    assert differences(spark, con, SMALL, QUERIES[name], ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
