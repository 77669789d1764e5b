import pathlib

import pytest
from oracle import connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert len(got) > 0
    assert difference(got, duck.execute(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.n_rows for r in rows) == 500
