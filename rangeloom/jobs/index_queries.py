"""Named loci, annotation text, summaries and their choice of level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import display, intervals, loci, measures, summary
from ..sources import tables as T
from . import sql as S
from .archive_queries import stored_tiles

SPAN = 256


def _loci(spark: SparkSession, sf: str) -> DataFrame:
    """Two names a part (its name and its type), at the part's place on its brand."""
    p = T.read(spark, sf, "part").select((F.col("p_partkey") + 1).alias("node_id"), "p_name", "p_type")
    v = intervals.reference_visits(T.reference_walk(spark, sf))
    named = p.withColumn("matched_name", F.explode(F.array(F.concat(F.lit(" "), F.initcap("p_name"), F.lit("\t")), F.col("p_type"))))
    held = named.join(v, "node_id").select("matched_name", F.col("p_name").alias("display_name"), F.concat(F.lit("P"), F.col("node_id").cast("string")).alias("stable_id"), F.lit("REF").alias("sample"), "contig", "start", "end")
    return loci.index(held)


def locus_index(spark: SparkSession, sf: str) -> DataFrame:
    return _loci(spark, sf).groupBy("normalized_key").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("contig").alias("contigs"), F.min("stable_id").alias("first_id"))


def _out(df: DataFrame) -> DataFrame:
    return df.select("normalized_key", "stable_id", "contig", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "truncated")


def locus_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _out(loci.search(_loci(spark, sf), "  Blue BOLT ", limit=20))


def locus_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _out(loci.search(_loci(spark, sf), "re", prefix=True, contig="Brand#3", limit=50))


def locus_resolve_command(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinate commands of every supplier, some with a sample, separators, single bases, unknown contigs."""
    s = T.read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    contig = F.concat(F.when(k % 7 == 0, F.lit("Nowhere")).otherwise(F.lit("Brand")), F.lit("."), (k % 25 + 1).cast("string"))
    command = F.concat(F.when(k % 3 == 0, F.lit("REF#")).when(k % 3 == 1, F.lit("ALT#")).otherwise(F.lit("")), contig, F.lit(":"), F.format_number(k * 37 + 1000, 0), F.when(k % 2 == 0, F.concat(F.lit("-"), (k * 37 + 2000).cast("string"))).otherwise(F.lit("")))
    manifests = T.manifests(spark, sf).withColumn("contig", F.replace(F.col("contig"), F.lit("#"), F.lit(".")))
    twins = manifests.where(F.col("manifest_id") % 2 == 0).withColumn("sample", F.lit("ALT"))
    return loci.resolve_commands(s.select(k.alias("supplier"), command.alias("command")), manifests.unionByName(twins), preferred=None).select("supplier", "command", "command_contig", "q_start", "q_end", "sample", "status")


def _gff(spark: SparkSession, sf: str) -> DataFrame:
    """GFF3 lines derived from parts: a gene each, every fifth an exon, with escapes and aliases."""
    p = T.read(spark, sf, "part")
    k, start = F.col("p_partkey"), F.col("p_size") * 10 + 800
    kind = F.when(k % 5 == 0, F.lit("exon")).otherwise(F.lit("gene"))
    strand = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("."), F.lit("?")), (k % 4 + 1).cast("int"))
    attributes = F.concat(F.lit("ID=g%3B"), k.cast("string"), F.lit(";Name="), F.replace(F.col("p_name"), F.lit(" "), F.lit("%20")), F.lit(";Alias=a+"), k.cast("string"), F.lit(",b"), (k % 10).cast("string"))
    return p.select(F.concat_ws("\t", "p_brand", F.lit("src"), kind, start.cast("string"), (start + k % 40).cast("string"), F.lit("."), strand, F.lit("."), attributes).alias("value"))


def gff_parse(spark: SparkSession, sf: str) -> DataFrame:
    return loci.parse_gff(_gff(spark, sf)).select("contig", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "strand", "stable_id", "display_name", "matched_name")


def gff_containment(spark: SparkSession, sf: str) -> DataFrame:
    held = loci.contained(loci.parse_gff(_gff(spark, sf)), T.manifests(spark, sf))
    return held.groupBy("contig").agg(F.count(F.lit(1)).alias("names"), F.countDistinct("stable_id").alias("features"), F.max("end").alias("last_end"))


def locus_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of messy names: the whole text of every document."""
    d = T.read(spark, sf, "documents")
    return d.select("doc_id", X.locus_key(F.concat(F.lit(" \t"), F.col("text"), F.lit("\n"))).alias("key"))


def _base(spark: SparkSession, sf: str) -> DataFrame:
    t = stored_tiles(spark, sf).withColumn("covered_bases", F.col("core_end") - F.col("core_start")).withColumn("tile_count", F.lit(1).cast("long")).withColumnsRenamed({"clen": "encoded_bytes", "ulen": "decoded_bytes"})
    return summary.base_bins(t, SPAN)


def summary_base(spark: SparkSession, sf: str) -> DataFrame:
    return summary.dense_bins(_base(spark, sf), SPAN)


def _pyramid(spark: SparkSession, sf: str) -> DataFrame:
    return summary.pyramid(_base(spark, sf), SPAN)


def summary_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    return _pyramid(spark, sf)


def summary_levels(spark: SparkSession, sf: str) -> DataFrame:
    return summary.level_counts(_pyramid(spark, sf))


def _clipped(spark: SparkSession, sf: str) -> DataFrame:
    picked = intervals.select_manifests(T.region_queries(spark, sf), T.manifests(spark, sf)).select("query_id", "manifest_id", "q_start", "q_end", F.when(F.col("query_id") % 2 == 0, 0).otherwise(1).alias("level"))
    return summary.query_bins(_pyramid(spark, sf), picked)


def summary_query(spark: SparkSession, sf: str) -> DataFrame:
    return _clipped(spark, sf).select("query_id", "manifest_id", "level", "clip_start", "clip_end", "coverage_fraction", "tile_count", "node_records")


def lod_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return summary.estimate(_clipped(spark, sf))


def region_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Limits that each order exceeds when its price stands for a span, with a region around it and bins for it."""
    o = T.read(spark, sf, "orders")
    span = F.floor("o_totalprice").cast("long")
    left, right = display.centred_region(F.col("o_orderkey") * 5, span, F.lit(0).cast("long"), F.lit(400_000).cast("long"))
    limits = display.exceeded_limits(span, span * 20, F.floor(span / 40_000))
    return o.select("o_orderkey", F.array_join(limits, ",").alias("exceeded"), left.alias("left_pos"), right.alias("right_pos"), display.recommended_bins(F.pmod(span, F.lit(6000))).cast("long").alias("bins"))


def network_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of reading each supplier's ranges one by one, on three networks."""
    r = T.stored_reads(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"))
    return r.select("key", *[F.round(measures.network_cost(F.col("n"), F.col("bytes"), F.lit(3), p), 6).alias(f"{p}_ms") for p in ("local", "broadband", "mobile")])


def _m(spark: SparkSession, sf: str) -> DataFrame:
    return T.measurements(spark, sf)


def dist_ceil(spark: SparkSession, sf: str) -> DataFrame:
    return measures.distribution_ceil(_m(spark, sf), ["class"], "latency").withColumnsRenamed({"max": "longest", "min": "shortest"})


def dist_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return measures.distribution_nearest_rank(_m(spark, sf), ["class"], "latency").withColumnsRenamed({"max": "longest", "min": "shortest"})


def run_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of two configurations by class, and their ratio."""
    d = measures.distribution_nearest_rank(_m(spark, sf), ["config", "class"], "latency", (50,)).select("config", "class", "p50")
    a, b = d.where(F.col("config") == "F").select("class", F.col("p50").alias("f_p50")), d.where(F.col("config") == "O").select("class", F.col("p50").alias("o_p50"))
    return a.join(b, "class").withColumn("ratio", F.round(measures.ratio(F.col("f_p50"), F.col("o_p50")), 9))


def grouped_dist(spark: SparkSession, sf: str) -> DataFrame:
    return measures.grouped_with_all(_m(spark, sf), "config", "class", "latency").withColumnsRenamed({"max": "longest", "min": "shortest"})


def pareto(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that no other part undercuts in size, price and key digits."""
    p = T.read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"), F.floor("p_retailprice").cast("long").alias("price"), F.pmod(F.col("p_partkey") * 7919, F.lit(1009)).alias("spread"))
    return measures.pareto_frontier(p, "p_partkey", ["size", "price", "spread"])


def argmin_choice(spark: SparkSession, sf: str) -> DataFrame:
    line = T.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.min("l_extendedprice").alias("price"))
    return measures.argmin(line, ["part"], "supplier", "price")


def request_rounds(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events").where(F.col("user_id").isNotNull())
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    r = measures.request_rounds(e.select(F.col("user_id").alias("key"), start.alias("start"), (start + F.floor(F.col("value")) * 60000 + 1).alias("end")), ["key"])
    return r.groupBy("key", "round").agg(F.count(F.lit(1)).alias("requests"), (F.max("end") - F.min("start")).alias("length_ms"))


def benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _m(spark, sf).groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("latency") <= 200_000).alias("passed"), F.count_if(F.col("latency") > 200_000).alias("failed"), F.max("latency").alias("slowest"))


def cache_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Entries a page and pages over their capacity, if every entry took 56 bytes of a page of 4 KiB."""
    b = intervals.tile_references(T.manifests(spark, sf)).groupBy("manifest_id", "bucket_id").agg(F.count(F.lit(1)).alias("entries"))
    return b.groupBy("manifest_id").agg(F.max("entries").alias("most"), F.count(F.lit(1)).alias("pages"), F.count_if(F.col("entries") > 72).alias("over"), F.sum(F.col("entries") * 56).alias("bytes"))


_LOCI = S.REFERENCE_WALK + ", " + S.VISITS + r""", loci AS (
  SELECT DISTINCT translate(trim(name, ' ' || chr(9) || chr(10) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normalized_key, 'P' || v.node_id::VARCHAR AS stable_id, v.contig, v.s, v.e, name, p_name
  FROM (SELECT p_partkey + 1 AS node_id, p_name, unnest([' ' || p_name || chr(9), p_type]) AS name FROM part) p JOIN visits v ON v.node_id = p.node_id)"""
_GFF = r"""gff AS (
  SELECT p_brand AS contig, p_size * 10 + 800 - 1 AS start_pos, p_size * 10 + 800 + p_partkey % 40 AS end_pos, ([1, 2, 0, 0])[p_partkey % 4 + 1]::INT AS strand,
         'g;' || p_partkey::VARCHAR AS stable_id, p_name AS display_name, unnest(['g;' || p_partkey::VARCHAR, p_name, 'a+' || p_partkey::VARCHAR, 'b' || (p_partkey % 10)::VARCHAR]) AS matched_name
  FROM part WHERE p_partkey % 5 <> 0)"""
_COUNTERS = "sum(covered_bases)::BIGINT AS covered_bases, sum(tile_count)::BIGINT AS tile_count, sum(encoded_bytes)::BIGINT AS encoded_bytes, sum(decoded_bytes)::BIGINT AS decoded_bytes, sum(node_records)::BIGINT AS node_records"
_SUMMARY = S.ARCHIVE + f""", counted AS (SELECT manifest_id, core_start, core_end - core_start AS covered_bases, 1 AS tile_count, clen AS encoded_bytes, ulen AS decoded_bytes, node_records FROM stored),
base AS (SELECT manifest_id, core_start // 256 * 256 AS bin_start, {_COUNTERS} FROM counted GROUP BY ALL),
ends AS (SELECT manifest_id, min(bin_start) AS lo, max(bin_start) AS hi FROM base GROUP BY ALL),
widths AS (SELECT i::INT AS level, 256 * (4 ** i)::BIGINT AS bin_span FROM range(0, 20) r(i)),
tops AS (SELECT manifest_id, min(level) AS top FROM ends, widths WHERE lo // bin_span = hi // bin_span GROUP BY manifest_id),
pyramid AS (SELECT b.manifest_id, w.level, w.bin_span, b.bin_start // w.bin_span * w.bin_span AS bin_start, {_COUNTERS} FROM base b JOIN tops t USING (manifest_id) JOIN widths w ON w.level <= t.top GROUP BY ALL),
clipped AS (SELECT q.query_id, p.*, greatest(p.bin_start, q.q_start) AS clip_start, least(p.bin_start + p.bin_span, q.q_end) AS clip_end FROM selected q JOIN pyramid p ON p.manifest_id = q.manifest_id AND p.level = q.query_id % 2 AND p.bin_start < q.q_end AND p.bin_start + p.bin_span > q.q_start)"""
_NAMES = ("covered_bases", "tile_count", "encoded_bytes", "decoded_bytes", "node_records")


def _pick(position: str, shares: tuple[int, ...] = (50, 90, 95, 99), keys: str = "class") -> str:
    picks = ", ".join(f"max(latency) FILTER (WHERE i = {position.format(p=p)}) AS p{p}" for p in shares)
    return f"SELECT {keys}, max(n) AS n, {picks}, max(latency) AS longest, min(latency) AS shortest FROM (SELECT o_orderstatus AS config, o_orderpriority AS class, o_totalprice AS latency, row_number() OVER (PARTITION BY {keys.replace('config', 'o_orderstatus').replace('class', 'o_orderpriority')} ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY {keys.replace('config', 'o_orderstatus').replace('class', 'o_orderpriority')}) AS n FROM orders) GROUP BY {keys}"


_SPAN = "floor(o_totalprice)::BIGINT"
_WIDTH = f"least({_SPAN}, 400000)"
_LEFT = f"greatest(0, least(o_orderkey * 5 - {_WIDTH} // 2, 400000 - {_WIDTH}))"

QUERIES = {
    "locus_index": (locus_index, f"WITH {_LOCI} SELECT normalized_key, count(*) AS records, count(DISTINCT contig) AS contigs, min(stable_id) AS first_id FROM loci GROUP BY normalized_key"),
    "locus_exact": (locus_exact, f"WITH {_LOCI}, hit AS (SELECT * FROM loci WHERE normalized_key = 'blue bolt') SELECT normalized_key, stable_id, contig, s AS start_pos, e AS end_pos, (SELECT count(*) FROM hit) > 20 AS truncated FROM hit ORDER BY normalized_key, contig, s, e, stable_id LIMIT 20"),
    "locus_prefix": (locus_prefix, f"WITH {_LOCI}, hit AS (SELECT * FROM loci WHERE normalized_key LIKE 're%' AND contig = 'Brand#3') SELECT normalized_key, stable_id, contig, s AS start_pos, e AS end_pos, (SELECT count(*) FROM hit) > 50 AS truncated FROM hit ORDER BY normalized_key, contig, s, e, stable_id LIMIT 50"),
    "locus_resolve_command": (locus_resolve_command, f"""WITH {S.REFERENCE_WALK}, {S.MANIFESTS}, m AS (SELECT replace(contig, '#', '.') AS contig, manifest_id FROM manifests),
c AS (SELECT s_suppkey AS supplier, CASE s_suppkey % 3 WHEN 0 THEN 'REF' WHEN 1 THEN 'ALT' END AS wanted, CASE WHEN s_suppkey % 7 = 0 THEN 'Nowhere.' ELSE 'Brand.' END || (s_suppkey % 25 + 1)::VARCHAR AS command_contig, s_suppkey * 37 + 1000 AS a, s_suppkey * 37 + CASE WHEN s_suppkey % 2 = 0 THEN 2000 ELSE 1000 END AS b FROM supplier),
j AS (SELECT c.*, m.contig IS NOT NULL AS known, coalesce(m.manifest_id % 2 = 0, false) AS two FROM c LEFT JOIN m ON m.contig = c.command_contig)
SELECT supplier, coalesce(wanted || '#', '') || command_contig || ':' || format('{{:,}}', a) || CASE WHEN supplier % 2 = 0 THEN '-' || b::VARCHAR ELSE '' END AS command, command_contig, a - 1 AS q_start, b AS q_end,
  CASE WHEN NOT known THEN NULL WHEN wanted = 'REF' THEN 'REF' WHEN wanted = 'ALT' THEN CASE WHEN two THEN 'ALT' END WHEN NOT two THEN 'REF' END AS sample,
  CASE WHEN NOT known THEN 'not found' WHEN wanted = 'REF' THEN 'ok' WHEN wanted = 'ALT' THEN CASE WHEN two THEN 'ok' ELSE 'not found' END WHEN two THEN 'ambiguous' ELSE 'ok' END AS status FROM j"""),
    "gff_parse": (gff_parse, f"WITH {_GFF} SELECT contig, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos, strand, stable_id, display_name, matched_name FROM gff"),
    "gff_containment": (gff_containment, f"WITH {S.REFERENCE_WALK}, {S.MANIFESTS}, {_GFF} SELECT g.contig, count(*) AS names, count(DISTINCT stable_id) AS features, max(end_pos)::BIGINT AS last_end FROM gff g WHERE EXISTS (SELECT 1 FROM manifests m WHERE m.contig = g.contig AND g.start_pos >= m.s AND g.end_pos <= m.e) GROUP BY g.contig"),
    "locus_keys": (locus_keys, "SELECT doc_id, translate(trim(' ' || chr(9) || text || chr(10), ' ' || chr(9) || chr(10) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM documents"),
    "summary_base": (summary_base, f"WITH {_SUMMARY}, grid AS (SELECT manifest_id, unnest(range(lo, hi + 1, 256)) AS bin_start FROM ends) SELECT manifest_id, bin_start, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _NAMES)} FROM grid LEFT JOIN base USING (manifest_id, bin_start)"),
    "summary_pyramid": (summary_pyramid, f"WITH {_SUMMARY} SELECT * FROM pyramid"),
    "summary_levels": (summary_levels, f"WITH {_SUMMARY} SELECT manifest_id, (top + 1)::BIGINT AS levels FROM tops"),
    "summary_query": (summary_query, f"WITH {_SUMMARY} SELECT query_id, manifest_id, level, clip_start, clip_end, (clip_end - clip_start)::DOUBLE / bin_span AS coverage_fraction, tile_count, node_records FROM clipped"),
    "lod_estimate": (lod_estimate, f"WITH {_SUMMARY} SELECT query_id, count(*) AS bins, {', '.join(f'sum(({c} * (clip_end - clip_start) + bin_span - 1) // bin_span)::BIGINT AS {c}' for c in _NAMES)} FROM clipped GROUP BY query_id"),
    "region_policy": (region_policy, f"SELECT o_orderkey, array_to_string(list_filter([CASE WHEN {_SPAN} > 100000 THEN 'span' END, CASE WHEN {_SPAN} * 20 > 4194304 THEN 'bytes' END, CASE WHEN {_SPAN} // 40000 > 8 THEN 'payloads' END], lambda x: x IS NOT NULL), ',') AS exceeded, {_LEFT} AS left_pos, {_LEFT} + {_WIDTH} AS right_pos, least(1024, greatest(32, ceil(({_SPAN} % 6000) / 4.0)))::BIGINT AS bins FROM orders"),
    "network_cost": (network_cost, f"WITH {S.READS}, t AS (SELECT key, count(*) AS n, sum(e - s)::BIGINT AS bytes FROM reads GROUP BY key) SELECT key, round(greatest(3, ceil(n / 8.0)) * 1.0 + bytes * 8 / 1000000.0, 6) AS local_ms, round(greatest(3, ceil(n / 6.0)) * 25.0 + bytes * 8 / 100000.0, 6) AS broadband_ms, round(greatest(3, ceil(n / 6.0)) * 90.0 + bytes * 8 / 20000.0, 6) AS mobile_ms FROM t"),
    "dist_ceil": (dist_ceil, _pick("((n - 1) * {p} + 99) // 100")),
    "dist_nearest_rank": (dist_nearest_rank, _pick("(n * {p} + 99) // 100 - 1")),
    "run_compare": (run_compare, f"WITH d AS ({_pick('(n * {p} + 99) // 100 - 1', (50,), 'config, class')}) SELECT a.class, a.p50 AS f_p50, b.p50 AS o_p50, round(a.p50 / b.p50, 9) AS ratio FROM d a JOIN d b ON a.class = b.class WHERE a.config = 'F' AND b.config = 'O'"),
    "grouped_dist": (grouped_dist, "SELECT o_orderstatus AS config, CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS class, count(*) AS n, min(o_totalprice) AS shortest, max(o_totalprice) AS longest FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))"),
    "pareto": (pareto, 'WITH p AS (SELECT p_partkey, p_size::BIGINT AS size, floor(p_retailprice)::BIGINT AS price, p_partkey * 7919 % 1009 AS spread FROM part) SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.size <= a.size AND b.price <= a.price AND b.spread <= a.spread AND (b.size < a.size OR b.price < a.price OR b.spread < a.spread))'),
    "argmin_choice": (argmin_choice, "SELECT part, supplier, price FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY price, supplier) AS r FROM (SELECT l_partkey AS part, l_suppkey AS supplier, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL)) WHERE r = 1"),
    "request_rounds": (request_rounds, 'WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + floor(value)::BIGINT * 60000 + 1 AS e FROM events WHERE user_id IS NOT NULL), m AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s >= max(e) OVER w THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS "round" FROM m) SELECT key, "round", count(*) AS requests, max(e) - min(s) AS length_ms FROM r GROUP BY ALL'),
    "benchmark_summary": (benchmark_summary, "SELECT o_orderstatus AS config, count(*) AS n, count(*) FILTER (WHERE o_totalprice <= 200000) AS passed, count(*) FILTER (WHERE o_totalprice > 200000) AS failed, max(o_totalprice) AS slowest FROM orders GROUP BY ALL"),
    "cache_pages": (cache_pages, f'WITH {S.REFERENCE}, b AS (SELECT manifest_id, bucket_id, count(*) AS entries FROM tiles GROUP BY ALL) SELECT manifest_id, max(entries) AS most, count(*) AS pages, count(*) FILTER (WHERE entries > 72) AS "over", sum(entries * 56)::BIGINT AS bytes FROM b GROUP BY manifest_id'),
}
