import pytest

from basketwise import plans

from .oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLE_SQL:
        assert_same(df, con, plans.ORACLE_SQL[name])
    else:
        assert df.count() > 0
