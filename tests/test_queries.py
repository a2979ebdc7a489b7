"""Every registered query runs on the smallest tables, and agrees with its SQL where it has one."""

from __future__ import annotations

import os

import pytest
from compare import duck, rows

from stratascope.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if sql := catalogue.oracle_sql().get(name):
        want = db.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
