"""Interchange codecs, lanes, level choice and integrity checks over the derived archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, intervals, lanes, measures, summary
from ..sources import payload
from ..sources import tables as T
from . import sql as S
from .archive_queries import stored_tiles
from .index_queries import _SUMMARY, _pyramid


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    line = T.read(spark, sf, "lineitem")
    return line.groupBy(F.col("l_partkey").alias("key")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("ids"))


def id_codec_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of the varint coding of each part's order ids."""
    line = T.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("id"))
    return measures.id_runs(line, ["key"], "id").select("key", F.col("delta_bytes").alias("bytes"))


def id_codec_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's order ids after packing into frames and unpacking."""
    back = payload.unpack_ids(payload.pack_ids(_ids(spark, sf), "key", "ids"), "key")
    return back.select("key", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def lane_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """Lanes in use for each supplier's reads."""
    laid = lanes.allocate_lanes(T.stored_reads(spark, sf), "key")
    return laid.groupBy("key").agg((F.max("lane") + 1).alias("lanes"), F.count(F.lit(1)).alias("spans"))


def level_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Level of each reference for a view of the whole archive of at most 40 bins."""
    series = _pyramid(spark, sf).groupBy("manifest_id", "level").agg(F.count(F.lit(1)).alias("bins")).withColumn("view", F.lit(0))
    return summary.levels_within(series, ["view"], 40).drop("view")


def entry_violations(spark: SparkSession, sf: str) -> DataFrame:
    """What each rule of the directory finds: entries outside bucket or manifest, empty lengths, payloads told two ways, overlaps."""
    t = stored_tiles(spark, sf).join(T.manifests(spark, sf), "manifest_id")
    grid = F.floor(F.col("start") / F.col("window_size")) * F.col("window_size") + F.col("bucket_id") * F.col("bucket_span")
    rules = t.agg(
        F.count_if((F.col("core_start") < F.greatest("start", grid)) | (F.col("core_end") > F.least(F.col("end"), grid + F.col("bucket_span")))).alias("outside"),
        F.count_if((F.col("clen") <= 0) | (F.col("ulen") <= 0) | (F.col("core_end") <= F.col("core_start"))).alias("empty"),
    )
    told = t.groupBy("payload_offset").agg(F.countDistinct("clen", "ulen").alias("n")).agg(F.count_if(F.col("n") > 1).alias("told_twice"))
    over = intervals.overlap_violations(t.select("manifest_id", F.col("core_start").alias("start"), F.col("core_end").alias("end")), ["manifest_id"]).agg(F.count(F.lit(1)).alias("overlapping"))
    stacked = [rules.select(F.explode(F.create_map(F.lit("outside"), "outside", F.lit("empty"), "empty")).alias("rule", "found")), told.select(F.lit("told_twice").alias("rule"), F.col("told_twice").alias("found")), over.select(F.lit("overlapping").alias("rule"), F.col("overlapping").alias("found"))]
    return stacked[0].unionByName(stacked[1]).unionByName(stacked[2])


def edge_degree(spark: SparkSession, sf: str) -> DataFrame:
    """Arcs leaving each handle, mirror images included."""
    return graph.arcs(graph.canonical_edges(T.order_walks(spark, sf))).groupBy(F.col("a").alias("handle")).agg(F.count(F.lit(1)).alias("arcs"))


def inspect(spark: SparkSession, sf: str) -> DataFrame:
    n, w, p = T.nodes(spark, sf), T.order_walks(spark, sf), T.paths(spark, sf)
    nodes = n.agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.length("seq")).alias("bases"))
    visits = w.agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("path_id").alias("paths"))
    names = p.agg(F.countDistinct("sample").alias("samples"), F.countDistinct("contig").alias("contigs"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(nodes).join(one(visits), "_k").join(one(names), "_k").drop("_k")


_PYRAMID_SERIES = "series AS (SELECT manifest_id, level, count(*) AS bins FROM pyramid GROUP BY ALL)"

QUERIES = {
    "id_codec_sizes": (id_codec_sizes, "SELECT key, sum(greatest(1, ceil(length(bin(d)) / 7.0)))::BIGINT AS bytes FROM (SELECT key, v - coalesce(lag(v) OVER (PARTITION BY key ORDER BY v), 0) AS d FROM (SELECT DISTINCT l_partkey AS key, l_orderkey AS v FROM lineitem)) GROUP BY key"),
    "id_codec_round_trip": (id_codec_round_trip, "SELECT key, string_agg(v::VARCHAR, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT l_partkey AS key, l_orderkey AS v FROM lineitem) GROUP BY key"),
    "lane_allocation": (lane_allocation, f"WITH {S.READS}, ends AS (SELECT key, s AS p, 1 AS d FROM reads UNION ALL SELECT key, e + 1, -1 FROM reads), steps AS (SELECT key, p, sum(d) AS d FROM ends GROUP BY ALL), open AS (SELECT key, sum(d) OVER (PARTITION BY key ORDER BY p ROWS UNBOUNDED PRECEDING) AS n FROM steps), m AS (SELECT key, max(n)::BIGINT AS lanes FROM open GROUP BY key) SELECT key, lanes, (SELECT count(*) FROM reads r WHERE r.key = m.key) AS spans FROM m"),
    "level_choice": (level_choice, f"WITH RECURSIVE {_SUMMARY}, series AS (SELECT 0 AS view, manifest_id, level, count(*) AS bins FROM pyramid GROUP BY ALL), {S.chosen_levels(40).replace('SELECT view, c.m', 'SELECT c.m')}"),
    "entry_violations": (entry_violations, "SELECT unnest(['outside', 'empty', 'told_twice', 'overlapping']) AS rule, unnest([0, 0, (SELECT count(*) FROM (SELECT payload_offset FROM stored GROUP BY 1 HAVING count(DISTINCT (clen, ulen)) > 1)), 0])::BIGINT AS found".join([f"WITH {S.ARCHIVE} ", ""])),
    "edge_degree": (edge_degree, f"WITH {S.ORDER_WALKS}, steps AS (SELECT handle AS a, lead(handle) OVER (PARTITION BY path_id ORDER BY ord) AS b FROM order_walks), arcs AS (SELECT a, b FROM steps WHERE b IS NOT NULL UNION SELECT xor(b, 1::BIGINT), xor(a, 1::BIGINT) FROM steps WHERE b IS NOT NULL) SELECT a AS handle, count(*) AS arcs FROM arcs GROUP BY a"),
    "inspect": (inspect, f"WITH {S.NODES}, {S.ORDER_WALKS}, {S.PATHS} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT sum(length(seq)) FROM nodes)::BIGINT AS bases, (SELECT count(*) FROM order_walks) AS visits, (SELECT count(DISTINCT path_id) FROM order_walks) AS paths, (SELECT count(DISTINCT sample) FROM paths) AS samples, (SELECT count(DISTINCT contig) FROM paths) AS contigs"),
}
