"""Every registered query against its SQL on the smallest tables."""

import pytest

from helpers import DATA, assert_matches, rows_of

from rangeloom.jobs import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    if name in SQL:
        assert_matches(df, duck, SQL[name])
    else:
        assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", ["plan_region", "weighted_walks", "coalesce_capped", "summary_pyramid", "alt_components"])
def test_result_does_not_depend_on_partitions(spark, name):
    results = []
    for n in ("1", "5", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows_of(catalogue.queries()[name](spark, DATA)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
