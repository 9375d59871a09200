"""Every query with SQL gives the same rows in Spark and in DuckDB; the others run."""

import pytest

from loamgrid.plans import bindings
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(bindings.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    got = rows(bindings.QUERIES[name](spark, SF).toPandas())
    assert got == rows(con.sql(bindings.ORACLE_SQL[name]).arrow().read_all().to_pandas())


@pytest.mark.parametrize("name", sorted(set(bindings.QUERIES) - set(bindings.ORACLE_SQL)))
def test_runs(spark, name):
    assert bindings.QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 21
