"""Every query with SQL equals DuckDB on the test tables, row by row."""

from __future__ import annotations

import pytest

from workload import all_queries, all_sql
from workload.verify import connect, difference

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small():
    return connect(SMALL)


@pytest.fixture(scope="module")
def larger():
    return connect(LARGER)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_small(spark, small, name):
    got = all_queries()[name](spark, SMALL).toPandas()
    assert difference(got, small.execute(all_sql()[name]).df()) is None


@pytest.mark.parametrize("name", ["group_split", "split_counts", "sink_split", "na_report", "sample_n_large",
                                  "cases_mapping_vs_model", "cases_bands", "foi_mapping_vs_posterior"])
def test_larger(spark, larger, name):
    got = all_queries()[name](spark, LARGER).toPandas()
    assert difference(got, larger.execute(all_sql()[name]).df()) is None


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
