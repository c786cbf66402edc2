"""Every registered query of the library against its SQL."""

import pytest
from inkwell import catalog

from tests.compare import connect, difference


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equal_to_sql(spark, con, small, name):
    assert difference(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).limit(5).count() == 5


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
