"""Walks through event tiles and order paths: successors, distinct weighted walks, memberships, display ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import handles as H
from ..functions import text as X
from ..operators import audit, chains, display, graph, measures, walks
from ..sources import tables as T
from ..sources.scratch import shared
from . import sql as S


def event_walks(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's whole walk through each tile; six hours bound its length."""
    v = T.event_visits(spark, sf)
    packed = v.groupBy("tile_id", "path_id").agg(F.array_sort(F.collect_list(F.struct("ord", "handle"))).alias("s"))
    return packed.select("tile_id", "path_id", F.transform("s", lambda s: s["handle"]).alias("walk"))


def event_records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Successor records of the event tiles, and those of them, a sixteenth and the ends, that name their path."""
    v = T.event_visits(spark, sf)
    records = chains.successor_records(walks.successors(v), audit.occurrences(v), ["tile_id"])
    records = shared(spark, "event-records", [T.read(spark, sf, "events")], lambda: records)
    sampled = (F.pmod(F.xxhash64("tile_id", "handle", "occurrence"), F.lit(16)) == 0) | F.col("next_handle").isNull()
    return records.drop("path_id"), records.where(sampled).select("tile_id", "handle", "occurrence", "path_id")


def record_walks(spark: SparkSession, sf: str) -> DataFrame:
    """Every walk of the event tiles rebuilt from successor records and sampled path names."""
    records, anchors = event_records(spark, sf)
    return _text(chains.walks_from_records(records, anchors, ["tile_id"]))


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    return walks.weighted_walks(event_walks(spark, sf))


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("walk", H.walk_key(F.col("walk")))


def weighted_walks(spark: SparkSession, sf: str) -> DataFrame:
    return _text(_weighted(spark, sf))


def _first_paths(spark: SparkSession, sf: str) -> DataFrame:
    """As reference walk of a tile: the walk of its smallest user id."""
    return event_walks(spark, sf).groupBy("tile_id").agg(F.min_by("walk", "path_id").alias("walk"))


def anonymous_walks(spark: SparkSession, sf: str) -> DataFrame:
    return _text(walks.weighted_walks(event_walks(spark, sf), _first_paths(spark, sf)))


def traversal_starts(spark: SparkSession, sf: str) -> DataFrame:
    return walks.traversal_starts(T.event_visits(spark, sf)).groupBy("tile_id", "handle").agg(F.count(F.lit(1)).alias("starts"))


def successor_edges(spark: SparkSession, sf: str) -> DataFrame:
    s = walks.successors(T.event_visits(spark, sf)).where(F.col("next_handle").isNotNull())
    return s.groupBy("tile_id", "handle", "next_handle").agg(F.count(F.lit(1)).alias("uses"))


def local_walks(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of order paths within tiles of a thousand part keys."""
    w = T.order_walks(spark, sf)
    nodes = T.nodes(spark, sf).select(F.floor(F.col("node_id") / 1000).alias("tile_id"), "node_id")
    return _text(walks.local_walks(w, nodes))


def walk_multiset_check(spark: SparkSession, sf: str) -> DataFrame:
    """Walks whose number changes when repeats of a handle are dropped first."""
    every = _weighted(spark, sf)
    v = display.adjacent_distinct(T.event_visits(spark, sf), ["tile_id", "path_id"], "handle")
    packed = v.groupBy("tile_id", "path_id").agg(F.array_sort(F.collect_list(F.struct("ord", "handle"))).alias("s")).select("tile_id", "path_id", F.transform("s", lambda s: s["handle"]).alias("walk"))
    return _text(walks.multiset_differences(every, walks.weighted_walks(packed)))


def memberships(spark: SparkSession, sf: str) -> DataFrame:
    return _text(walks.memberships(event_walks(spark, sf))).withColumnRenamed("reversed", "is_reversed")


def membership_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _text(walks.membership_groups(walks.memberships(event_walks(spark, sf))))


def membership_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Named groups against the anonymous walks without the reference: exactly the reference walks differ."""
    groups = walks.membership_groups(walks.memberships(event_walks(spark, sf)))
    return _text(walks.unmatched_groups(groups, walks.weighted_walks(event_walks(spark, sf), _first_paths(spark, sf))))


def membership_totals(spark: SparkSession, sf: str) -> DataFrame:
    g = walks.membership_groups(walks.memberships(event_walks(spark, sf)))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("occurrence_weight").alias("occurrences"), F.sum("unique_path_count").alias("unique_path_sum"), F.max("occurrence_weight").alias("most"), F.countDistinct("tile_id").alias("tiles"))


def referenced_paths(spark: SparkSession, sf: str) -> DataFrame:
    members = T.order_walks(spark, sf).select("path_id")
    catalog = T.paths(spark, sf)
    return walks.referenced_paths(members.join(catalog.select("path_id"), "path_id", "left_semi"), catalog).select("path_id", "canonical_name", "sample")


def walk_digests(spark: SparkSession, sf: str) -> DataFrame:
    w = _weighted(spark, sf)
    digest = walks.walk_digest(F.lit("REF"), F.lit("events"), F.col("tile_id") * T.EVENT_TILE_MS, (F.col("tile_id") + 1) * T.EVENT_TILE_MS, F.col("walk"))
    return w.select("tile_id", digest.alias("digest"), "weight")


def tile_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return walks.tile_evidence(_weighted(spark, sf))


def canonical_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.canonical_edges(T.order_walks(spark, sf))


def edge_activation(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the order paths with both ends among parts of small size."""
    nodes = T.nodes(spark, sf).where(F.length("seq") <= 9)
    return graph.edges_within(graph.canonical_edges(T.order_walks(spark, sf)), nodes)


def pattern_topn(spark: SparkSession, sf: str) -> DataFrame:
    return _text(display.top_patterns(_weighted(spark, sf), 100))


def pattern_ranks(spark: SparkSession, sf: str) -> DataFrame:
    r = display.ranked_patterns(_weighted(spark, sf), 8)
    return _text(r.withColumn("thickness", display.thickness(F.col("weight"))))


def lanes_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _text(display.retained_lanes(_weighted(spark, sf), 24))


def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    v = T.event_visits(spark, sf).groupBy("tile_id", H.node_of(F.col("handle")).alias("node_id")).agg(F.min("ord").alias("ord"))
    return display.first_seen(v)


def node_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Per supplier at most 40 of the parts it ships, cheap parts first."""
    line, part = T.read(spark, sf, "lineitem"), T.read(spark, sf, "part")
    nodes = line.select(F.col("l_suppkey").alias("key"), F.col("l_partkey")).distinct().join(part, F.col("l_partkey") == F.col("p_partkey"))
    budget = display.node_budget(nodes.select("key", F.col("p_partkey").alias("node_id"), (F.col("p_size") <= 10).alias("is_reference")), 40)
    return budget.where("kept").select("key", "node_id", "is_reference", "place", "omitted")


def collapsed_chains(spark: SparkSession, sf: str) -> DataFrame:
    v = T.event_visits(spark, sf).withColumn("chain", H.is_reverse(F.col("handle")))
    c = graph.collapsed_chains(v.withColumnRenamed("path_id", "user"), ["user", "tile_id"], most=3)
    return c.groupBy("user", "tile_id", "run", "part").agg(F.count(F.lit(1)).alias("visits"), F.min("ord").alias("first_ord"))


def walk_sequence(spark: SparkSession, sf: str) -> DataFrame:
    w = T.order_walks(spark, sf)
    packed = w.groupBy(F.col("path_id").alias("walk_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "handle"))).alias("s")).select("walk_id", F.transform("s", lambda s: s["handle"]).alias("walk"))
    return walks.walk_sequences(packed, T.nodes(spark, sf)).select("walk_id", "sequence")


def walk_fasta(spark: SparkSession, sf: str) -> DataFrame:
    s = walk_sequence(spark, sf)
    return s.select("walk_id", X.fasta(F.concat(F.lit("walk_"), F.col("walk_id").cast("string")), F.col("sequence"), 20).alias("record"))


def path_tsv(spark: SparkSession, sf: str) -> DataFrame:
    w = T.order_walks(spark, sf).groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("ord", "handle"))).alias("s")).select("path_id", F.transform("s", lambda s: s["handle"]).alias("walk"))
    return display.path_table(w.join(T.paths(spark, sf), "path_id"))


def reverse_complement(spark: SparkSession, sf: str) -> DataFrame:
    return T.nodes(spark, sf).select("node_id", X.reverse_complement(F.col("seq")).alias("rc"))


def path_search(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred paths of a sample and contig, and whether there are more."""
    hit = T.paths(spark, sf).where((F.col("sample") == "NATION_3") & (F.col("contig") == "MACHINERY"))
    top = hit.orderBy("path_id").limit(101)
    at = F.row_number().over(Window.orderBy("path_id"))
    return top.withColumn("at", at).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > 100).where(F.col("at") <= 100).select("path_id", "canonical_name", "truncated")


def path_by_ids_all(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the paths of every list, order and repeats kept, unknown ids without a name."""
    line = T.read(spark, sf, "lineitem").select((F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 10**9).otherwise(0)).alias("path_id"), F.col("l_partkey").alias("pos"), F.col("l_suppkey").alias("list_id"))
    return line.join(T.paths(spark, sf).select("path_id", "canonical_name"), "path_id", "left").select("list_id", "pos", "path_id", "canonical_name")


def path_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    """path_by_ids_all under its first name."""
    return path_by_ids_all(spark, sf)


def path_names(spark: SparkSession, sf: str) -> DataFrame:
    return T.paths(spark, sf)


def id_runs(spark: SparkSession, sf: str) -> DataFrame:
    line = T.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("path_id"))
    return measures.id_runs(line, ["key"], "path_id")


_G = S.EVENT_GROUPS
_REF = "reference AS (SELECT tile_id, arg_min(walk, path_id) AS walk FROM event_walks GROUP BY tile_id), anonymous AS (SELECT w.tile_id, w.walk, w.weight - CASE WHEN r.walk IS NULL THEN 0 ELSE 1 END AS weight FROM weighted w LEFT JOIN reference r ON r.tile_id = w.tile_id AND r.walk = w.walk)"
_GROUPS = "grouped AS (SELECT tile_id, walk, count(*) AS occurrence_weight, count(DISTINCT path_id) AS unique_path_count FROM canonical GROUP BY tile_id, walk)"
_DEDUP = f"""thin AS (SELECT * FROM (SELECT *, lag(handle) OVER (PARTITION BY tile_id, path_id ORDER BY ord) AS p FROM event_visits) WHERE p IS DISTINCT FROM handle),
thin_walks AS (SELECT tile_id, path_id, list(handle ORDER BY ord) AS walk FROM thin GROUP BY tile_id, path_id),
thin_strands AS (SELECT tile_id, walk FROM thin_walks UNION ALL SELECT tile_id, list_transform(list_reverse(walk), lambda h: xor(h, 1::BIGINT)) FROM thin_walks),
thin_weighted AS (SELECT tile_id, walk, count(*) AS weight FROM thin_strands WHERE CASE WHEN walk[1] % 2 = walk[len(walk)] % 2 THEN walk[1] % 2 = 0 ELSE {S.canonical_edge("walk[1]", "walk[len(walk)]")} END GROUP BY tile_id, walk)"""
_KEPT = S.canonical_edge("a", "b")
_EDGES = f"""steps AS (SELECT handle AS a, lead(handle) OVER (PARTITION BY path_id ORDER BY ord) AS b FROM order_walks),
edges AS (SELECT DISTINCT CASE WHEN {_KEPT} THEN a ELSE xor(b, 1::BIGINT) END AS from_handle, CASE WHEN {_KEPT} THEN b ELSE xor(a, 1::BIGINT) END AS to_handle FROM steps WHERE b IS NOT NULL)"""
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY weight DESC, walk) AS local_rank FROM weighted)"
_RC = "translate(reverse(seq), 'ACGT', 'TGCA')"
_SEQ = f"spelled AS (SELECT w.path_id AS walk_id, string_agg(CASE WHEN w.handle % 2 = 1 THEN {_RC} ELSE seq END, '' ORDER BY w.ord) AS sequence FROM order_walks w JOIN nodes n ON n.node_id = w.node_id GROUP BY w.path_id)"

QUERIES = {
    "record_walks": (record_walks, f"WITH {S.EVENT_VISITS}, {S.EVENT_WALKS} SELECT tile_id, path_id, {S.WALK_TEXT} AS walk FROM event_walks"),
    "weighted_walks": (weighted_walks, f"WITH {_G} SELECT tile_id, {S.WALK_TEXT} AS walk, weight FROM weighted"),
    "anonymous_walks": (anonymous_walks, f"WITH {_G}, {_REF} SELECT tile_id, {S.WALK_TEXT} AS walk, weight FROM anonymous WHERE weight > 0"),
    "traversal_starts": (traversal_starts, f"WITH {S.EVENT_VISITS} SELECT tile_id, handle, count(*) AS starts FROM event_visits WHERE ord = 1 GROUP BY tile_id, handle"),
    "successor_edges": (successor_edges, f"WITH {S.EVENT_VISITS} SELECT a.tile_id, a.handle, b.handle AS next_handle, count(*) AS uses FROM event_visits a JOIN event_visits b ON a.tile_id = b.tile_id AND a.path_id = b.path_id AND b.ord = a.ord + 1 GROUP BY ALL"),
    "local_walks": (local_walks, f"WITH {S.ORDER_WALKS}, {S.NODES}, held AS (SELECT *, node_id // 1000 AS tile_id FROM order_walks WHERE node_id IN (SELECT node_id FROM nodes)), runs AS (SELECT *, ord - row_number() OVER (PARTITION BY tile_id, path_id ORDER BY ord) AS piece FROM held) SELECT tile_id, path_id, piece, string_agg(handle::VARCHAR, ',' ORDER BY ord) AS walk FROM runs GROUP BY tile_id, path_id, piece"),
    "walk_multiset_check": (walk_multiset_check, f"WITH {_G}, {_DEDUP} SELECT tile_id, {S.WALK_TEXT} AS walk, weight_a, weight_b FROM (SELECT coalesce(a.tile_id, b.tile_id) AS tile_id, coalesce(a.walk, b.walk) AS walk, coalesce(a.weight, 0) AS weight_a, coalesce(b.weight, 0) AS weight_b FROM weighted a FULL JOIN thin_weighted b ON a.tile_id = b.tile_id AND a.walk = b.walk) WHERE weight_a <> weight_b"),
    "memberships": (memberships, f"WITH {_G} SELECT tile_id, {S.WALK_TEXT} AS walk, path_id, is_reversed, count(*) AS multiplicity FROM canonical GROUP BY ALL"),
    "membership_groups": (membership_groups, f"WITH {_G}, {_GROUPS} SELECT tile_id, {S.WALK_TEXT} AS walk, occurrence_weight, unique_path_count FROM grouped"),
    "membership_mismatches": (membership_mismatches, f"WITH {_G}, {_REF}, {_GROUPS} SELECT g.tile_id, {S.WALK_TEXT.replace('walk,', 'g.walk,')} AS walk, g.occurrence_weight, g.unique_path_count, a.weight FROM grouped g LEFT JOIN (SELECT * FROM anonymous WHERE weight > 0) a ON a.tile_id = g.tile_id AND a.walk = g.walk WHERE a.weight IS DISTINCT FROM g.occurrence_weight"),
    "membership_totals": (membership_totals, f"WITH {_G}, {_GROUPS} SELECT count(*) AS groups, sum(occurrence_weight)::BIGINT AS occurrences, sum(unique_path_count)::BIGINT AS unique_path_sum, max(occurrence_weight) AS most, count(DISTINCT tile_id) AS tiles FROM grouped"),
    "referenced_paths": (referenced_paths, f"WITH {S.ORDER_WALKS}, {S.PATHS} SELECT DISTINCT path_id, canonical_name, sample FROM paths WHERE path_id IN (SELECT path_id FROM order_walks)"),
    "walk_digests": (walk_digests, f"WITH {_G} SELECT tile_id, sha256('REF|events|' || (tile_id * 21600000)::VARCHAR || '|' || ((tile_id + 1) * 21600000)::VARCHAR || '|' || {S.WALK_TEXT}) AS digest, weight FROM weighted"),
    "tile_evidence": (tile_evidence, f"WITH {_G} SELECT tile_id, count(*) AS walks, sum(weight)::BIGINT AS total_weight, sum(len(walk) * weight)::BIGINT AS weighted_visits FROM weighted GROUP BY tile_id"),
    "canonical_edges": (canonical_edges, f"WITH {S.ORDER_WALKS}, {_EDGES} SELECT * FROM edges"),
    "edge_activation": (edge_activation, f"WITH {S.ORDER_WALKS}, {S.NODES}, {_EDGES}, small AS (SELECT node_id FROM nodes WHERE length(seq) <= 9) SELECT * FROM edges WHERE from_handle // 2 IN (SELECT node_id FROM small) AND to_handle // 2 IN (SELECT node_id FROM small)"),
    "pattern_topn": (pattern_topn, f"WITH {_G}, {_RANKED} SELECT tile_id, {S.WALK_TEXT} AS walk, weight, local_rank::INT AS local_rank FROM (SELECT * FROM ranked ORDER BY local_rank, weight DESC, tile_id, walk LIMIT 100)"),
    "pattern_ranks": (pattern_ranks, f"WITH {_G}, {_RANKED} SELECT tile_id, {S.WALK_TEXT} AS walk, weight, local_rank::INT AS local_rank, least(9, greatest(2, 1 + length(bin(weight))))::INT AS thickness FROM ranked WHERE local_rank <= 8"),
    "lanes_topk": (lanes_topk, f"WITH {_G} SELECT tile_id, {S.WALK_TEXT} AS walk, weight, lane::INT AS lane FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY weight DESC, len(walk), walk) AS lane FROM weighted) WHERE lane <= 24"),
    "first_seen": (first_seen, f"WITH {S.EVENT_VISITS} SELECT node_id, tile_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY tile_id, ord) AS r FROM (SELECT handle // 2 AS node_id, tile_id, ord FROM event_visits)) WHERE r = 1"),
    "node_budget": (node_budget, "SELECT key, node_id, is_reference, place::INT AS place, greatest(0, n - 40) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY NOT is_reference, node_id) AS place, count(*) OVER (PARTITION BY key) AS n FROM (SELECT DISTINCT l_suppkey AS key, p_partkey AS node_id, p_size <= 10 AS is_reference FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE place <= 40"),
    "collapsed_chains": (collapsed_chains, f'WITH {S.EVENT_VISITS}, marked AS (SELECT *, CASE WHEN lag(handle % 2) OVER (PARTITION BY path_id, tile_id ORDER BY ord) IS NOT DISTINCT FROM handle % 2 THEN 0 ELSE 1 END AS fresh FROM event_visits), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY path_id, tile_id ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM marked), parts AS (SELECT *, (row_number() OVER (PARTITION BY path_id, tile_id, run ORDER BY ord) - 1) // 3 AS part FROM runs) SELECT path_id AS "user", tile_id, run, part, count(*) AS visits, min(ord) AS first_ord FROM parts GROUP BY ALL'),
    "walk_sequence": (walk_sequence, f"WITH {S.ORDER_WALKS}, {S.NODES}, {_SEQ} SELECT walk_id, sequence FROM spelled"),
    "walk_fasta": (walk_fasta, f"WITH {S.ORDER_WALKS}, {S.NODES}, {_SEQ} SELECT walk_id, '>walk_' || walk_id::VARCHAR || chr(10) || array_to_string(list_transform(range(0, length(sequence), 20), lambda i: substr(sequence, i + 1, 20)), chr(10)) AS record FROM spelled"),
    "path_tsv": (path_tsv, f"WITH {S.ORDER_WALKS}, {S.PATHS}, w AS (SELECT path_id, string_agg(handle::VARCHAR, ',' ORDER BY ord) AS walk FROM order_walks GROUP BY path_id) SELECT path_id, concat_ws(chr(9), canonical_name, sample, contig, haplotype::VARCHAR, fragment::VARCHAR, walk) AS line FROM w JOIN paths USING (path_id)"),
    "reverse_complement": (reverse_complement, f"WITH {S.NODES} SELECT node_id, {_RC} AS rc FROM nodes"),
    "path_search": (path_search, f"WITH {S.PATHS}, hit AS (SELECT * FROM paths WHERE sample = 'NATION_3' AND contig = 'MACHINERY') SELECT path_id, canonical_name, (SELECT count(*) FROM hit) > 100 AS truncated FROM hit ORDER BY path_id LIMIT 100"),
    "path_by_ids": (path_by_ids, f"WITH {S.PATHS}, asked AS (SELECT l_suppkey AS list_id, l_partkey AS pos, l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS path_id FROM lineitem) SELECT list_id, pos, path_id, canonical_name FROM asked LEFT JOIN paths USING (path_id)"),
    "path_by_ids_all": (path_by_ids_all, f"WITH {S.PATHS}, asked AS (SELECT l_suppkey AS list_id, l_partkey AS pos, l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS path_id FROM lineitem) SELECT list_id, pos, path_id, canonical_name FROM asked LEFT JOIN paths USING (path_id)"),
    "path_names": (path_names, f"WITH {S.PATHS} SELECT path_id, canonical_name, sample, contig, haplotype, fragment FROM paths"),
    "id_runs": (id_runs, "WITH one AS (SELECT DISTINCT l_suppkey AS key, l_orderkey AS v FROM lineitem), d AS (SELECT *, v - lag(v) OVER (PARTITION BY key ORDER BY v) AS d FROM one), t AS (SELECT key, count(*) AS ids, sum(CASE WHEN coalesce(d, 0) = 1 THEN 0 ELSE 1 END)::BIGINT AS runs, sum(greatest(1, ceil(length(bin(coalesce(d, v))) / 7.0)))::BIGINT AS delta_bytes FROM d GROUP BY key) SELECT *, runs * 16 AS run_bytes, CASE WHEN runs * 16 < delta_bytes THEN 'runs' ELSE 'delta' END AS codec FROM t"),
}
