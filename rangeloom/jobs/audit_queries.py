"""Audits, reconciliations and text scans over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import handles as H
from ..operators import audit, digests, graph, measures, walks
from ..operators.ordered import prefix_sums
from ..sources import gfa
from ..sources import tables as T
from . import sql as S
from .walk_queries import event_walks


def locate_starts(spark: SparkSession, sf: str) -> DataFrame:
    """The user of each walk start, found again from its tile, handle and occurrence alone."""
    v = T.event_visits(spark, sf)
    starts = walks.traversal_starts(audit.occurrences(v).select("tile_id", "path_id", "ord", "handle", "occurrence")).select("tile_id", "handle", "occurrence")
    return audit.locate(starts, v).select("tile_id", "handle", F.col("occurrence").cast("long").alias("occurrence"), "path_id")


def successor_runs(spark: SparkSession, sf: str) -> DataFrame:
    return audit.successor_runs(T.event_visits(spark, sf))


def run_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Successors by handle after coding as runs and expanding again."""
    back = audit.expanded_runs(audit.successor_runs(T.event_visits(spark, sf)))
    return back.groupBy("tile_id", "handle", "successor").agg(F.count(F.lit(1)).alias("uses"), F.min("occurrence").alias("first_occurrence"))


def path_name_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Expected (sample, contig) pairs against those of the catalog, by a parse of its names."""
    names = T.paths(spark, sf).select(F.regexp_extract("canonical_name", r"^([^#]+)#(\d+)#([^#]+)(?:#fragment=(\d+))?$", 1).alias("sample"), F.regexp_extract("canonical_name", r"^([^#]+)#(\d+)#([^#]+)", 3).alias("contig"))
    seen = names.select(F.concat_ws("/", "sample", "contig").alias("name"))
    n = T.read(spark, sf, "nation")
    segments = T.read(spark, sf, "customer").select("c_mktsegment").distinct()
    expected = n.where("n_nationkey % 3 <> 0").select("n_name").join(segments.where("c_mktsegment <> 'MACHINERY'").withColumn("_k", F.lit(1)), F.lit(1) == F.col("_k")).select(F.concat_ws("/", "n_name", "c_mktsegment").alias("name"))
    return audit.name_audit(expected, seen, "name")


def workload_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on a workload of orders: some expect a digest, some an error, some both or none."""
    o = T.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    digest = F.md5(k.cast("string"))
    expected_hash = F.when(k % 5 != 0, digest)
    expected_error = F.when((k % 5 == 0) | (k % 7 == 0), F.when(k % 2 == 0, "reference-not-found").otherwise("too long"))
    actual_hash = F.when(k % 11 != 0, digest)
    actual_error = F.when(k % 5 == 0, F.lit("contig not found in archive"))
    return o.select(audit.outcome(expected_hash, expected_error, actual_hash, actual_error).alias("outcome"), (k % 5).alias("kind")).groupBy("outcome", "kind").agg(F.count(F.lit(1)).alias("queries"))


def log_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that readers saw against those that the origin logged: order lines by part and by supplier."""
    line = T.read(spark, sf, "lineitem")
    seen = line.where("l_linenumber <> 3").groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))
    logged = line.where("l_linenumber <> 5").groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))
    return audit.pairing(seen, logged, ["key"], ["n", "bytes"]).groupBy("status").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.coalesce("a_bytes", F.lit(0)) - F.coalesce("b_bytes", F.lit(0))).alias("difference"))


def manifest_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """References against the names of parts, one to one with equal counts of visits."""
    v = T.reference_walk(spark, sf).groupBy("contig").agg(F.count(F.lit(1)).alias("entries"))
    w = T.read(spark, sf, "part").where("p_size < 50").groupBy(F.col("p_brand").alias("contig")).agg(F.count(F.lit(1)).alias("entries"))
    return audit.pairing(v, w, ["contig"], ["entries"])


def contig_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Customer rows renamed by two joins: key to nation, nation to region."""
    c, n, r = (T.read(spark, sf, t) for t in ("customer", "nation", "region"))
    held = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return held.select("c_custkey", F.concat_ws(":", "r_name", "n_name", "c_mktsegment").alias("contig"))


def grouped_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the order paths between groups of a hundred parts."""
    groups = T.nodes(spark, sf).select("node_id", F.floor(F.col("node_id") / 100).alias("group"))
    return audit.grouped_edges(graph.canonical_edges(T.order_walks(spark, sf)), groups)


def membership_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Distribution of walk weights and of distinct users a walk, by tile of a week."""
    g = walks.membership_groups(walks.memberships(event_walks(spark, sf))).withColumn("week", F.floor(F.col("tile_id") / 28))
    weights = measures.distribution_ceil(g, ["week"], "occurrence_weight", (50, 95)).select("week", F.col("n").alias("groups"), F.col("p50").alias("weight_p50"), F.col("p95").alias("weight_p95"), F.col("max").alias("weight_max"))
    unique = measures.distribution_ceil(g, ["week"], "unique_path_count", (50, 95)).select("week", F.col("p50").alias("paths_p50"), F.col("p95").alias("paths_p95"))
    return weights.join(unique, "week")


def gfa_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The reference graph written as GFA lines and read again: segments, links and steps with their sums."""
    nodes = T.nodes(spark, sf).select(F.concat_ws("\t", F.lit("S"), F.col("node_id").cast("string"), "seq").alias("value"))
    ref = T.reference_walk(spark, sf).select(F.col("contig").alias("path_id"), "ord", "handle")
    side = lambda h: F.when(H.is_reverse(F.col(h)), "-").otherwise("+")
    edges = graph.canonical_edges(ref, long=True).select(F.concat_ws("\t", F.lit("L"), H.node_of(F.col("from_handle")).cast("string"), side("from_handle"), H.node_of(F.col("to_handle")).cast("string"), side("to_handle"), F.lit("0M")).alias("value"))
    # A path is a line for each segment of it, named by its first place, so no line is as long as a contig.
    cut = ref.withColumn("at", F.floor(F.col("ord") / 1024)).groupBy("path_id", "at").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(H.node_of(F.col("handle")).cast("string"), F.lit("+")).alias("s")))).alias("w"))
    paths = cut.select(F.concat_ws("\t", F.lit("P"), F.concat("path_id", F.lit("["), (F.col("at") * 1024).cast("string"), F.lit("]")), F.array_join(F.transform("w", lambda x: x["s"]), ","), F.lit("*")).alias("value"))
    lines = nodes.union(edges).union(paths)
    s = gfa.segments(lines).agg(F.lit("S").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("total"))
    li = gfa.links(lines).agg(F.lit("L").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("to_handle").alias("total"))
    p = gfa.path_steps(lines, r"Brand#1\d*\[\d+\]").agg(F.lit("P").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("handle").alias("total"))
    return s.unionByName(li).unionByName(p)


def graph_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of each contig's nodes, edges and walk, none of which is ever gathered."""
    ref = T.reference_walk(spark, sf)
    held = ref.join(T.nodes(spark, sf), "node_id")
    nodes = digests.tree_digest(held, ["contig"], "node_id", F.concat_ws(":", F.col("node_id").cast("string"), "seq"))
    walk = digests.tree_digest(ref, ["contig"], "ord", F.col("handle").cast("string"))
    at = prefix_sums(ref, ["contig"], "ord", F.lit(1)).select("contig", "before", F.col("handle").alias("from_handle"))
    edges = at.join(at.select("contig", (F.col("before") - 1).alias("before"), F.col("from_handle").alias("to_handle")), ["contig", "before"])
    edges = digests.edge_digest(edges, ["contig"])
    parts = nodes.withColumnRenamed("digest", "n").join(edges.select("contig", F.col("digest").alias("e")), "contig", "left").join(walk.select("contig", F.col("digest").alias("w")), "contig")
    return parts.select("contig", digests.graph_digest(F.col("n"), F.col("e"), F.col("w")).alias("digest"), F.col("leaves").alias("visits"))


def node_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Display width of each node, and how many of each contig are wide."""
    w = T.reference_walk(spark, sf).withColumn("width", F.least(F.lit(140.0), F.greatest(F.lit(28.0), 18 + 8 * F.log2(F.col("seq_len") + 1.0))))
    return w.groupBy("contig").agg(F.count_if(F.col("width") > 40).alias("wide"), F.count(F.lit(1)).alias("nodes"), F.round(F.max("width"), 6).alias("widest"))


_KEPT = S.canonical_edge("a", "b")
_EDGES = f"edges AS (SELECT DISTINCT CASE WHEN {_KEPT} THEN a ELSE xor(b, 1::BIGINT) END AS from_handle, CASE WHEN {_KEPT} THEN b ELSE xor(a, 1::BIGINT) END AS to_handle FROM (SELECT handle AS a, lead(handle) OVER (PARTITION BY path_id ORDER BY ord) AS b FROM order_walks) WHERE b IS NOT NULL)"
_NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY tile_id, handle ORDER BY path_id, ord) - 1 AS occurrence, coalesce(lead(handle) OVER (PARTITION BY tile_id, path_id ORDER BY ord), 0) AS successor FROM event_visits)"
_GROUPED = "grouped AS (SELECT tile_id // 28 AS week, occurrence_weight AS w, unique_path_count AS u FROM (SELECT tile_id, walk, count(*) AS occurrence_weight, count(DISTINCT path_id) AS unique_path_count FROM canonical GROUP BY tile_id, walk))"

QUERIES = {
    "locate_starts": (locate_starts, f"WITH {S.EVENT_VISITS}, {_NUMBERED} SELECT tile_id, handle, occurrence, path_id FROM numbered WHERE ord = 1"),
    "successor_runs": (successor_runs, f"WITH {S.EVENT_VISITS}, {_NUMBERED}, marked AS (SELECT *, CASE WHEN lag(successor) OVER (PARTITION BY tile_id, handle ORDER BY occurrence) IS NOT DISTINCT FROM successor THEN 0 ELSE 1 END AS fresh FROM numbered), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY tile_id, handle ORDER BY occurrence ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM marked) SELECT tile_id, handle, run, successor, count(*) AS length FROM runs GROUP BY ALL"),
    "run_round_trip": (run_round_trip, f"WITH {S.EVENT_VISITS}, {_NUMBERED} SELECT tile_id, handle, successor, count(*) AS uses, min(occurrence) AS first_occurrence FROM numbered GROUP BY ALL"),
    "path_name_audit": (path_name_audit, f"WITH {S.PATHS}, seen AS (SELECT sample || '/' || contig AS name, count(*) AS seen FROM paths GROUP BY ALL), wanted AS (SELECT DISTINCT n_name || '/' || c_mktsegment AS name FROM nation, (SELECT DISTINCT c_mktsegment FROM customer) WHERE n_nationkey % 3 <> 0 AND c_mktsegment <> 'MACHINERY') SELECT coalesce(w.name, s.name) AS name, coalesce(seen, 0) AS seen, CASE WHEN w.name IS NULL THEN 'extra' WHEN s.name IS NULL THEN 'missing' WHEN seen > 1 THEN 'duplicate' ELSE 'found' END AS status FROM wanted w FULL JOIN seen s ON w.name = s.name"),
    "workload_outcomes": (workload_outcomes, "WITH q AS (SELECT o_orderkey AS k FROM orders) SELECT CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN 'invalid workload' WHEN k % 5 <> 0 THEN CASE WHEN k % 11 <> 0 THEN 'passed' ELSE 'failed' END WHEN k % 2 = 0 THEN 'passed' ELSE 'failed' END AS outcome, k % 5 AS kind, count(*) AS queries FROM q GROUP BY ALL"),
    "log_reconciliation": (log_reconciliation, "WITH a AS (SELECT l_partkey AS key, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS b FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL), c AS (SELECT l_partkey AS key, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS b FROM lineitem WHERE l_linenumber <> 5 GROUP BY ALL) SELECT CASE WHEN c.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'extra' WHEN a.n = c.n AND a.b = c.b THEN 'same' ELSE 'differs' END AS status, count(*) AS keys, sum(coalesce(a.b, 0) - coalesce(c.b, 0))::BIGINT AS difference FROM a FULL JOIN c ON a.key = c.key GROUP BY ALL"),
    "manifest_pairing": (manifest_pairing, "WITH a AS (SELECT p_brand AS contig, count(*) AS e FROM part GROUP BY ALL), b AS (SELECT p_brand AS contig, count(*) AS e FROM part WHERE p_size < 50 GROUP BY ALL) SELECT coalesce(a.contig, b.contig) AS contig, a.e AS a_entries, b.e AS b_entries, CASE WHEN b.e IS NULL THEN 'missing' WHEN a.e IS NULL THEN 'extra' WHEN a.e = b.e THEN 'same' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.contig = b.contig"),
    "contig_mapping": (contig_mapping, "SELECT c_custkey, concat_ws(':', r_name, n_name, c_mktsegment) AS contig FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "grouped_edges": (grouped_edges, f'WITH {S.ORDER_WALKS}, {_EDGES}, m AS (SELECT from_handle // 2 // 100 AS from_group, to_handle // 2 // 100 AS to_group, * FROM edges WHERE from_handle // 2 IN (SELECT p_partkey + 1 FROM part) AND to_handle // 2 IN (SELECT p_partkey + 1 FROM part)), r AS (SELECT *, row_number() OVER (PARTITION BY from_group, to_group ORDER BY from_handle, to_handle) AS i, count(*) OVER (PARTITION BY from_group, to_group) AS edges FROM m WHERE from_group <> to_group) SELECT from_group, to_group, from_handle, to_handle, edges FROM r WHERE i = 1'),
    "membership_shape": (membership_shape, f"WITH {S.EVENT_GROUPS}, {_GROUPED}, a AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY w) - 1 AS i, row_number() OVER (PARTITION BY week ORDER BY u) - 1 AS j, count(*) OVER (PARTITION BY week) AS n FROM grouped) SELECT week, max(n) AS groups, max(w) FILTER (WHERE i = ((n - 1) * 50 + 99) // 100) AS weight_p50, max(w) FILTER (WHERE i = ((n - 1) * 95 + 99) // 100) AS weight_p95, max(w) AS weight_max, max(u) FILTER (WHERE j = ((n - 1) * 50 + 99) // 100) AS paths_p50, max(u) FILTER (WHERE j = ((n - 1) * 95 + 99) // 100) AS paths_p95 FROM a GROUP BY week"),
    "gfa_scan": (gfa_scan, f"WITH {S.NODES}, {S.REFERENCE_WALK}, l AS (SELECT lead(handle) OVER (PARTITION BY contig ORDER BY ord) AS b FROM reference_walk) SELECT 'S' AS kind, count(*) AS n, sum(length(seq))::BIGINT AS total FROM nodes UNION ALL SELECT 'L', count(b), sum(b)::BIGINT FROM l UNION ALL SELECT 'P', count(*), sum(handle)::BIGINT FROM reference_walk WHERE regexp_full_match(contig, 'Brand#1\\d*')"),
    "graph_digest": (graph_digest, f"""WITH {S.NODES}, {S.REFERENCE_WALK}, listed AS (SELECT * FROM reference_walk JOIN nodes USING (node_id)),
steps AS (SELECT * FROM (SELECT contig, handle AS from_handle, lead(handle) OVER (PARTITION BY contig ORDER BY ord) AS to_handle FROM reference_walk) WHERE to_handle IS NOT NULL),
{S.tree_digest("listed", "contig", "node_id", "node_id::VARCHAR || ':' || seq", "n")}, {S.tree_digest("listed", "contig", "ord", "handle::VARCHAR", "w")},
{S.tree_digest("steps", "contig, from_handle", "to_handle", "to_handle::VARCHAR", "ends")}, {S.tree_digest("ends", "contig", "from_handle", "from_handle::VARCHAR || ':' || digest", "e")},
sized AS (SELECT contig, count(*) AS visits FROM listed GROUP BY contig)
SELECT contig, sha256('graph:' || concat_ws(':', n.digest, coalesce(e.digest, '-'), w.digest)) AS digest, visits FROM sized JOIN n USING (contig) LEFT JOIN e USING (contig) JOIN w USING (contig)"""),
    "node_widths": (node_widths, f"WITH {S.REFERENCE_WALK}, w AS (SELECT contig, least(140.0, greatest(28.0, 18 + 8 * log2(seq_len + 1.0)))::DOUBLE AS width FROM reference_walk) SELECT contig, count(*) FILTER (WHERE width > 40) AS wide, count(*) AS nodes, round(max(width), 6) AS widest FROM w GROUP BY contig"),
}
