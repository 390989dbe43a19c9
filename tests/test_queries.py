"""Every registered query against its SQL answer on the smallest tables."""

import pytest

from __spark_entry__ import entry
from checks.compare import difference, duck
from checks.registry import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"



@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name in SQL:
        assert difference(got, con.execute(SQL[name]).df()) is None
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry(spark).columns == ["slice_id", "ts", "loss", "series_id", "sq_error", "rank"]
