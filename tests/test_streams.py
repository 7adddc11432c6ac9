"""Streams over a folder of part files, each of which spans the whole time range."""

import duckdb
import pytest
from helpers import DATA, assert_matches
from pyspark.sql import functions as F

from rangeloom.jobs import stream_queries


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events, stretched over 150 days, dealt over five files by the hash of their id."""
    folder = tmp_path_factory.mktemp("parts")
    e = spark.read.parquet(f"{DATA}/events.parquet")
    first = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = e.schema["ts"].dataType.simpleString()
    e.withColumn("ts", F.timestamp_micros(us + (us - first) * 4).cast(kind)).repartition(5, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", list(stream_queries.QUERIES))
def test_shuffled_files_lose_no_event(spark, parts, name):
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{parts}/events.parquet/*.parquet'")
    query, sql = stream_queries.QUERIES[name]
    assert_matches(query(spark, parts), con, sql)
