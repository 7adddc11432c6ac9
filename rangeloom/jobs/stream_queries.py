"""Streams run to their end over the events table, and what their sinks then hold."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources.scratch import scratch_dir, shared_folder
from ..streaming import tiles, views
from . import sql as S
from .graph_queries import haplotypes

#: Places of a view: nodes, edges and walks that it shows.
BUDGETS = {"node": 60, "edge": 80, "lane": 24}


def _folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"


def _path(sf: str) -> str:
    return f"{sf}/events.parquet"


def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by window and type, as an update stream whose last version of each window counts."""
    counts = tiles.tumbling_counts(tiles.event_stream(spark, _path(sf)), late=tiles.whole_span(spark, _path(sf)))
    return tiles.run_upserts(counts, ["window_start", "event_type"], _folder(spark), "summary")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Closed sessions: those that end a day or more before the last event are written.

    The watermark says what is closed, so it can't wait for files out of order: they come as one micro-batch.
    """
    done = tiles.run_to_table(tiles.sessions(tiles.event_stream(spark, _path(sf), None)), _folder(spark), "sessions")
    return done.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("longest"))


def stream_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct events passed through, then counted by tile."""
    events = tiles.distinct_events(tiles.event_stream(spark, _path(sf)), late=tiles.whole_span(spark, _path(sf)))
    passed = tiles.run_to_table(events.select("event_id", "event_type", F.unix_micros("time").alias("us")), _folder(spark), "events")
    return passed.groupBy(F.floor(F.col("us") / 21_600_000_000).alias("tile_id"), "event_type").agg(F.count(F.lit(1)).alias("events"))


def _view_items(spark: SparkSession, sf: str) -> DataFrame:
    """What the haplotypes add to the view of each contig: nodes, those of the reference strand first; edges between them; walks, the longest first."""
    ref = T.reference_walk(spark, sf).select("node_id", F.col("contig").alias("view"))
    h = haplotypes(spark, sf).join(ref, "node_id")

    def rank(handle: str) -> Column:
        return F.pmod(F.col(handle), F.lit(2)) * (1 << 40) + F.col(handle)

    def items(rows: DataFrame, kind: str, item: Column, priority: Column, weight: Column) -> DataFrame:
        return rows.select("view", F.lit(kind).alias("kind"), item.alias("item"), priority.alias("priority"), weight.alias("weight"))

    one = F.lit(1).cast("long")
    steps = h.withColumn("after", F.lead("handle").over(Window.partitionBy("view", "path_id").orderBy("ord"))).where(F.col("after").isNotNull())
    lanes = h.groupBy("view", "path_id").agg(F.count(F.lit(1)).alias("n"))
    nodes = items(h, "node", F.col("handle").cast("string"), rank("handle"), one)
    edges = items(steps, "edge", F.concat_ws(">", F.col("handle").cast("string"), F.col("after").cast("string")), F.greatest(rank("handle"), rank("after")), one)
    return nodes.union(edges).union(items(lanes, "lane", F.col("path_id").cast("string"), -F.col("n"), F.col("n")))


def view_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The bounded view of each contig after all that the haplotypes bring has come in as a stream of files."""
    path = shared_folder(spark, "view-items", [T.read(spark, sf, t) for t in ("part", "lineitem")], lambda p: _view_items(spark, sf).write.parquet(p))
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(path)
    held = views.run_views(rows, BUDGETS, _folder(spark), "view")
    return views.snapshot(held, BUDGETS, {"edge": ("node", F.split("item", ">"))})


_RANK = "{0} % 2 * 1099511627776 + {0}"
_VIEW = f"""WITH {S.REFERENCE_WALK}, {S.HAPLOTYPES},
h AS (SELECT r.contig AS view, x.path_id, x.ord, x.handle FROM haplotypes x JOIN reference_walk r USING (node_id)),
steps AS (SELECT view, handle AS a, lead(handle) OVER (PARTITION BY view, path_id ORDER BY ord) AS b FROM h),
nodes AS (SELECT view, handle, count(*) AS seen FROM h GROUP BY ALL),
kept_nodes AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY {_RANK.format("handle")}) AS place FROM nodes QUALIFY place <= {BUDGETS["node"]}),
between AS (SELECT view, a, b, count(*) AS seen FROM steps WHERE (view, a) IN (SELECT view, handle FROM kept_nodes) AND (view, b) IN (SELECT view, handle FROM kept_nodes) GROUP BY ALL),
lanes AS (SELECT view, path_id, count(*) AS n FROM h GROUP BY ALL),
decoded AS (SELECT view, 'node' AS kind, count(*) AS decoded FROM h GROUP BY view UNION ALL SELECT view, 'edge', count(*) FROM steps WHERE b IS NOT NULL GROUP BY view UNION ALL SELECT view, 'lane', count(*) FROM lanes GROUP BY view),
shown AS (
  SELECT view, 'node' AS kind, place, handle::VARCHAR AS item, seen, seen AS weight FROM kept_nodes
  UNION ALL SELECT view, 'edge', row_number() OVER (PARTITION BY view ORDER BY greatest({_RANK.format("a")}, {_RANK.format("b")}), a || '>' || b) AS place, a || '>' || b, seen, seen FROM between QUALIFY place <= {BUDGETS["edge"]}
  UNION ALL SELECT view, 'lane', row_number() OVER (PARTITION BY view ORDER BY n DESC, path_id::VARCHAR) AS place, path_id::VARCHAR, 1, n FROM lanes QUALIFY place <= {BUDGETS["lane"]})
SELECT view, kind, place::INT AS place, item, seen, weight, decoded, decoded - count(*) OVER (PARTITION BY view, kind) AS omitted FROM shown JOIN decoded USING (view, kind)"""

_SESSIONS = """WITH t AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, sum(CASE WHEN p IS NULL OR us >= p + 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM t),
s AS (SELECT user_id, k, count(*) AS events, max(us) + 7200000000 AS e FROM n GROUP BY ALL)
SELECT user_id, count(*) AS sessions, sum(events)::BIGINT AS events, max(events) AS longest FROM s
WHERE e // 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 86400000 FROM events) GROUP BY user_id"""

QUERIES = {
    "view_snapshot": (view_snapshot, _VIEW),
    "stream_summary": (stream_summary, "SELECT epoch_us(ts) // 21600000000 * 21600 AS window_start, event_type, count(*) AS events, sum(floor(value))::BIGINT AS value_sum FROM events WHERE ts IS NOT NULL GROUP BY ALL"),
    "stream_sessions": (stream_sessions, _SESSIONS),
    "stream_tiles": (stream_tiles, "SELECT epoch_us(ts) // 21600000000 AS tile_id, event_type, count(*) AS events FROM events WHERE ts IS NOT NULL GROUP BY ALL"),
}
