"""Scans over rows that tie in their order: the same span read many times is one span."""

import pytest
from helpers import assert_matches, rows_of
from pyspark.sql import functions as F

from rangeloom.jobs import archive_queries
from rangeloom.operators.ordered import coalesced, running_count


def test_tied_rows_share_one_count(spark):
    # The row that opens the second span lies anywhere among its copies, as a shuffle between two scans may leave them.
    rows = [(k, 0, s, e, int(s != 8 or i == k)) for k in range(4) for s, e, n in ((0, 4, 1), (8, 9, 4), (20, 24, 1)) for i in range(n)]
    counted = running_count(spark.createDataFrame(rows, "key long, _block long, start long, end long, opens int").coalesce(1), ["key"], ["start", "end"], F.col("opens"))
    want = [(k, s, c) for k in range(4) for s, c, n in ((0, 1, 1), (8, 2, 4), (20, 3, 1)) for _ in range(n)]
    assert rows_of(counted, ["key", "start", "_count"]) == sorted(want, key=repr)


def test_copies_do_not_join_the_span_before(spark):
    spans = [(k, 10 * i, 10 * i + 1 + k % 3) for k in range(20) for i in range(30) for _ in range(1 + (i + k) % 4)]
    rows = spark.createDataFrame(spans, "key long, start long, end long").repartition(7)
    want = sorted(((k, 10 * i, 10 * i + 1 + k % 3, 1 + (i + k) % 4) for k in range(20) for i in range(30)), key=repr)
    assert rows_of(coalesced(rows, ["key"], "start", "end"), ["key", "start", "end", "members"]) == want


@pytest.fixture
def lines(duck):
    con = duck.cursor()
    con.execute("CREATE OR REPLACE TEMP VIEW lineitem AS SELECT * FROM '/root/testdata/sf0.01/lineitem.parquet'")
    return con


def test_read_summary_of_larger_tables(spark, lines):
    query, sql = archive_queries.QUERIES["read_summary"]
    assert_matches(query(spark, "/root/testdata/sf0.01"), lines, sql)
