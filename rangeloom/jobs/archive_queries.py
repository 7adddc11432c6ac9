"""References, tiles, lookups and range planning over the derived archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, intervals
from ..operators.ordered import coalesced, islands
from ..sources import tables as T
from . import sql as S


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.tile_references(T.manifests(spark, sf))


def _visits(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.reference_visits(T.reference_walk(spark, sf))


def stored_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles with what their payload holds; neighbours share a payload offset in pairs."""
    tiles, visits = _tiles(spark, sf), _visits(spark, sf)
    span = T.WINDOW_BASES
    # A visit touches few windows: filed by window number, it meets its tiles in an equi-join.
    filed = visits.select("contig", "seq_len", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("end") - 1) / span))).alias("_w"))
    held = tiles.withColumn("_w", F.floor(F.col("core_start") / span)).join(filed, ["contig", "_w"])
    held = held.groupBy("manifest_id", "bucket_id", "tile_index", "core_start", "core_end").agg(F.count(F.lit(1)).alias("node_records"), F.sum("seq_len").alias("bases"))
    zero = F.lit(0)
    ulen = graph.payload_size(F.col("node_records"), F.col("bases"), zero, zero, zero)
    held = held.withColumn("ulen", ulen).withColumn("clen", F.floor(F.col("ulen") / 3) + 20)
    return held.withColumn("payload_offset", F.col("manifest_id") * 1_000_000 + F.floor(F.col("tile_index") / 2) * 1000)


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.select_manifests(T.region_queries(spark, sf), T.manifests(spark, sf), strict=False)


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.look_up_tiles(_selected(spark, sf), stored_tiles(spark, sf))


def plan_region(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.plan_totals(_found(spark, sf))


def references(spark: SparkSession, sf: str) -> DataFrame:
    return T.manifests(spark, sf).select("manifest_id", "sample", "contig", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.lit("forward").alias("orientation"))


def archive_info(spark: SparkSession, sf: str) -> DataFrame:
    t = stored_tiles(spark, sf)
    return t.agg(F.countDistinct("manifest_id").alias("references"), F.count(F.lit(1)).alias("tiles"), F.countDistinct("manifest_id", "bucket_id").alias("buckets"), F.sum("ulen").alias("decoded_bytes"), F.sum("clen").alias("compressed_bytes"), F.max("node_records").alias("most_nodes"))


def fixed_tiling(spark: SparkSession, sf: str) -> DataFrame:
    return _tiles(spark, sf).select("manifest_id", "tile_index", "core_start", "core_end")


def directory_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return _tiles(spark, sf).groupBy("manifest_id", "bucket_id").agg(F.count(F.lit(1)).alias("entries"), F.min("core_start").alias("first_start"), F.max("core_end").alias("last_end")).withColumn("page_offset", F.col("manifest_id") * 65536 + F.col("bucket_id") * 4096)


def manifest_select(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf).select("query_id", "manifest_id", F.greatest("q_start", "start").alias("clip_start"), F.least("q_end", "end").alias("clip_end"))


def directory_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf).select("query_id", "manifest_id", "bucket_id", "tile_index", "core_start", "core_end")


def reference_visits(spark: SparkSession, sf: str) -> DataFrame:
    return _visits(spark, sf).select("contig", "ord", "handle", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


def position_lookup(spark: SparkSession, sf: str) -> DataFrame:
    q = T.region_queries(spark, sf).select("query_id", "contig", F.col("q_start").alias("position"))
    return intervals.locate_positions(q, _visits(spark, sf)).select("query_id", "position", "node_id", "node_offset")


def read_summary(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.read_summary(T.stored_reads(spark, sf), ["key"], 64)


def range_union(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.union_length(T.stored_reads(spark, sf), ["key"])


def coalesce_gap(spark: SparkSession, sf: str) -> DataFrame:
    return coalesced(T.stored_reads(spark, sf), ["key"], "start", "end", 512).select("key", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "members")


def coalesce_capped(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.coalesce_capped(T.stored_reads(spark, sf), ["key"], gap=512, cap=4096).select("key", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "members")


def plan_max_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.limit_ranges(coalesced(T.stored_reads(spark, sf), ["key"], "start", "end").drop("members"), ["key"], 16).select("key", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "members")


def span_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of consecutive page numbers that each supplier's reads touch."""
    pages = T.stored_reads(spark, sf).select("key", F.floor(F.col("start") / 64).alias("start")).distinct().withColumn("end", F.col("start") + 1)
    return coalesced(pages, ["key"], "start", "end").select("key", F.col("start").alias("first_page"), (F.col("end") - 1).alias("last_page"), F.col("members").alias("pages"))


def overlap_check(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.overlap_violations(T.stored_reads(spark, sf), ["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("overlaps"), F.max(F.col("reach") - F.col("start")).alias("deepest"))


def time_union(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.union_length(_event_spans(spark, sf), ["key"])


def exclusive_union(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.exclusive_union(_event_spans(spark, sf), ["key"], F.col("kind") == "purchase")


def _event_spans(spark: SparkSession, sf: str) -> DataFrame:
    """A span of as many minutes as an event's value for each event, by user."""
    e = T.read(spark, sf, "events")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.where(F.col("user_id").isNotNull()).select(F.col("user_id").alias("key"), F.col("event_type").alias("kind"), start.alias("start"), (start + F.floor(F.col("value")) * 60000 + 1).alias("end"))


def payload_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Content-addressed texts: how often each digest is stored, and the bytes that sharing saves."""
    d = T.read(spark, sf, "documents").where(F.col("text").isNotNull())
    held = d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("uses"), F.min("doc_id").alias("first_id"), F.min(F.octet_length("text")).cast("long").alias("bytes"), F.min(F.md5("text")).alias("_a"), F.max(F.md5("text")).alias("_b"))
    return held.where(F.col("_a") == F.col("_b")).select("digest", "uses", "first_id", (F.col("bytes") * (F.col("uses") - 1)).alias("saved_bytes"))


def directory_order_check(spark: SparkSession, sf: str) -> DataFrame:
    """Entries a bucket and whether its tiles touch without gap or overlap, for every bucket."""
    runs = islands(_tiles(spark, sf).select("manifest_id", "bucket_id", F.col("core_start").alias("start"), F.col("core_end").alias("end")), ["manifest_id", "bucket_id"], "start", "end")
    return runs.groupBy("manifest_id", "bucket_id").agg(F.max("island").alias("stretches"), F.sum(F.col("end") - F.col("start")).alias("bases"), (F.count(F.lit(1)) <= 72).alias("fits_page"))


_SPANS = "spans AS (SELECT user_id AS key, event_type AS kind, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + floor(value)::BIGINT * 60000 + 1 AS e FROM events WHERE user_id IS NOT NULL)"

QUERIES = {
    "plan_region": (plan_region, f"WITH {S.ARCHIVE} SELECT query_id, sum(uses)::BIGINT AS tile_count, count(*) AS payload_count, sum(clen)::BIGINT AS compressed_bytes, sum(ulen)::BIGINT AS decoded_bytes FROM (SELECT query_id, payload_offset, clen, ulen, count(*) AS uses FROM found GROUP BY ALL) GROUP BY query_id"),
    "references": (references, f"WITH {S.REFERENCE} SELECT manifest_id, sample, contig, s AS start_pos, e AS end_pos, 'forward' AS orientation FROM manifests"),
    "archive_info": (archive_info, f'WITH {S.ARCHIVE} SELECT count(DISTINCT manifest_id) AS "references", count(*) AS tiles, count(DISTINCT (manifest_id, bucket_id)) AS buckets, sum(ulen)::BIGINT AS decoded_bytes, sum(clen)::BIGINT AS compressed_bytes, max(node_records) AS most_nodes FROM stored'),
    "fixed_tiling": (fixed_tiling, f"WITH {S.REFERENCE} SELECT manifest_id, tile_index, core_start, core_end FROM tiles"),
    "directory_buckets": (directory_buckets, f"WITH {S.REFERENCE} SELECT manifest_id, bucket_id, count(*) AS entries, min(core_start) AS first_start, max(core_end) AS last_end, manifest_id * 65536 + bucket_id * 4096 AS page_offset FROM tiles GROUP BY manifest_id, bucket_id"),
    "directory_order_check": (directory_order_check, f"WITH {S.REFERENCE} SELECT manifest_id, bucket_id, 1 + sum(CASE WHEN prev IS NOT NULL AND prev <> core_start THEN 1 ELSE 0 END)::BIGINT AS stretches, sum(core_end - core_start)::BIGINT AS bases, count(*) <= 72 AS fits_page FROM (SELECT *, lag(core_end) OVER (PARTITION BY manifest_id, bucket_id ORDER BY core_start) AS prev FROM tiles) GROUP BY manifest_id, bucket_id"),
    "manifest_select": (manifest_select, f"WITH {S.ARCHIVE} SELECT query_id, manifest_id, greatest(q_start, s) AS clip_start, least(q_end, e) AS clip_end FROM selected"),
    "directory_lookup": (directory_lookup, f"WITH {S.ARCHIVE} SELECT query_id, manifest_id, bucket_id, tile_index, core_start, core_end FROM found"),
    "reference_visits": (reference_visits, f"WITH {S.REFERENCE} SELECT contig, ord, handle, s AS start_pos, e AS end_pos FROM visits"),
    "position_lookup": (position_lookup, f"WITH {S.REFERENCE}, {S.QUERIES} SELECT q.query_id, q.q_start AS position, v.node_id, q.q_start - v.s AS node_offset FROM region_queries q ASOF JOIN visits v ON q.contig = v.contig AND q.q_start >= v.s WHERE q.q_start < v.e"),
    "read_summary": (read_summary, f"WITH {S.READS}, {S.islands('reads', 'key', 64)}, {S.merged('key')}, {S.islands('reads', 'key', 0, 'exact')}, {S.merged('key', 'exact', 'unioned')}, t AS (SELECT key, count(*) AS operations, sum(e - s)::BIGINT AS total_bytes, min(e - s) AS min_bytes, max(e - s) AS max_bytes FROM reads GROUP BY key), m AS (SELECT key, count(*) AS coalesced_ranges, sum(e - s)::BIGINT AS coalesced_bytes FROM merged GROUP BY key), u AS (SELECT key, sum(e - s)::BIGINT AS unique_bytes FROM unioned GROUP BY key) SELECT *, greatest(0, total_bytes - unique_bytes) AS duplicate_bytes, operations - coalesced_ranges AS mergeable FROM t JOIN m USING (key) JOIN u USING (key)"),
    "range_union": (range_union, f"WITH {S.READS}, {S.islands('reads', 'key', 0)}, {S.merged('key')} SELECT key, sum(e - s)::BIGINT AS covered, count(*) AS stretches FROM merged GROUP BY key"),
    "coalesce_gap": (coalesce_gap, f"WITH {S.READS}, {S.islands('reads', 'key', 512)}, {S.merged('key')} SELECT key, s AS start_pos, e AS end_pos, members FROM merged"),
    "coalesce_capped": (coalesce_capped, f"""WITH RECURSIVE {S.READS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, e) AS i FROM reads),
fold AS (SELECT key, i, s AS cs, e AS ce, 1::BIGINT AS g FROM numbered WHERE i = 1
  UNION ALL SELECT n.key, n.i, CASE WHEN n.s <= f.ce + 512 AND greatest(f.ce, n.e) - f.cs <= 4096 THEN f.cs ELSE n.s END, CASE WHEN n.s <= f.ce + 512 AND greatest(f.ce, n.e) - f.cs <= 4096 THEN greatest(f.ce, n.e) ELSE n.e END,
    CASE WHEN n.s <= f.ce + 512 AND greatest(f.ce, n.e) - f.cs <= 4096 THEN f.g ELSE f.g + 1 END FROM fold f JOIN numbered n ON n.key = f.key AND n.i = f.i + 1)
SELECT key, min(cs) AS start_pos, max(ce) AS end_pos, count(*) AS members FROM fold GROUP BY key, g"""),
    "plan_max_ranges": (plan_max_ranges, f"""WITH {S.READS}, {S.islands('reads', 'key', 0)}, {S.merged('key')},
spaced AS (SELECT *, s - lag(e) OVER (PARTITION BY key ORDER BY s) AS gap, row_number() OVER (PARTITION BY key ORDER BY s) AS i FROM merged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gap NULLS LAST, i) AS r, count(*) OVER (PARTITION BY key) AS n FROM spaced),
runs AS (SELECT *, sum(CASE WHEN gap IS NULL OR r > n - 16 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM ranked)
SELECT key, min(s) AS start_pos, max(e) AS end_pos, count(*) AS members FROM runs GROUP BY key, run"""),
    "span_islands": (span_islands, f"WITH {S.READS}, pages AS (SELECT DISTINCT key, s // 64 AS p FROM reads), runs AS (SELECT *, p - row_number() OVER (PARTITION BY key ORDER BY p) AS run FROM pages) SELECT key, min(p) AS first_page, max(p) AS last_page, count(*) AS pages FROM runs GROUP BY key, run"),
    "overlap_check": (overlap_check, f"WITH {S.READS}, one AS (SELECT DISTINCT * FROM reads), reach AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM one) SELECT key, count(*) AS overlaps, max(reach - s) AS deepest FROM reach WHERE s < reach GROUP BY key"),
    "time_union": (time_union, f"WITH {_SPANS}, {S.islands('spans', 'key', 0)}, {S.merged('key')} SELECT key, sum(e - s)::BIGINT AS covered, count(*) AS stretches FROM merged GROUP BY key"),
    "exclusive_union": (exclusive_union, f"""WITH {_SPANS}, cuts AS (SELECT key, s AS p FROM spans UNION SELECT key, e FROM spans),
cells AS (SELECT key, p AS a, lead(p) OVER (PARTITION BY key ORDER BY p) AS b FROM cuts),
covered AS (SELECT c.key, c.a, c.b, bool_or(p.kind = 'purchase') AS want, bool_or(p.kind <> 'purchase') AS block FROM cells c JOIN spans p ON p.key = c.key AND p.s <= c.a AND p.e >= c.b GROUP BY ALL)
SELECT k.key, coalesce((SELECT sum(b - a) FROM covered c WHERE c.key = k.key AND want AND NOT block), 0)::BIGINT AS exclusive FROM (SELECT DISTINCT key FROM spans) k"""),
    "payload_dedup": (payload_dedup, "SELECT sha256(text) AS digest, count(*) AS uses, min(doc_id) AS first_id, (min(strlen(text)) * (count(*) - 1))::BIGINT AS saved_bytes FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)"),
}
