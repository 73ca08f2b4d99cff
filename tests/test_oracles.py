import pytest

from tests.conftest import SMALL
from tests.oracle import canonical, connect
from weftline.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, name):
    ours, theirs = canonical(QUERIES[name](spark, SMALL).toPandas()), canonical(con.execute(SQL[name]).df())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a == pytest.approx(b, rel=2e-5, abs=2e-5) if all(isinstance(x, (int, float)) for x in (*a, *b)) else a == b


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
