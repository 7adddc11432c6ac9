"""Operators on small hand-made inputs: edge cases, errors, and plain Python models."""

import random

import pytest
from helpers import choose_levels, rows_of
from pyspark.sql import functions as F

from rangeloom.functions import handles as H
from rangeloom.functions import text as X
from rangeloom.operators import display, graph, intervals, loci, measures, summary, walks
from rangeloom.operators.ordered import coalesced, prefix_sums


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


def test_handles(spark):
    assert value(spark, H.pack(F.lit(5), F.lit(True))) == 11
    assert value(spark, H.flip(F.lit(11))) == 10
    df = spark.createDataFrame([(a, b) for a in range(2, 8) for b in range(2, 8)], "a long, b long")
    mirror = df.select("a", "b", H.is_canonical_edge(F.col("a"), F.col("b")).alias("k"), H.is_canonical_edge(H.flip(F.col("b")), H.flip(F.col("a"))).alias("m"))
    for r in mirror.collect():
        own_mirror = (r.b ^ 1, r.a ^ 1) == (r.a, r.b)
        assert r.k or r.m
        assert r.k != r.m or own_mirror


def test_percent_decoding(spark):
    assert value(spark, X.percent_decode(F.lit("a+b%20%C3%A9"))) == "a+b é"
    with pytest.raises(Exception, match="malformed"):
        value(spark, X.percent_decode(F.lit("a%2")))


def test_locus_key_keeps_accents(spark):
    assert value(spark, X.locus_key(F.lit("\t ÀbC \r\n"))) == "Àbc"


def test_reverse_complement(spark):
    assert value(spark, X.reverse_complement(F.lit("ACGTRn"))) == "nYACGT"
    with pytest.raises(Exception, match="nucleotide"):
        value(spark, X.reverse_complement(F.lit("ACU")))


def test_fasta_wraps(spark):
    assert value(spark, X.fasta(F.lit("h"), F.lit("A" * 160))) == ">h\n" + "A" * 80 + "\n" + "A" * 80


def test_prefix_sums_over_blocks(spark):
    df = spark.createDataFrame([("a", i, i % 7) for i in range(300)] + [("b", 5, 1)], "k string, ord long, v long")
    got = {(r.k, r.ord): r.before for r in prefix_sums(df, ["k"], "ord", F.col("v"), block=32).collect()}
    assert all(got["a", i] == sum(j % 7 for j in range(i)) for i in range(300)) and got["b", 5] == 0


def test_missing_reference_is_an_error(spark):
    m = spark.createDataFrame([(1, "S", "c", 0, 100)], "manifest_id long, sample string, contig string, start long, end long")
    q = spark.createDataFrame([(1, "S", "c", 10, 20), (2, "S", "other", 10, 20)], "query_id long, sample string, contig string, q_start long, q_end long")
    assert [r.query_id for r in intervals.select_manifests(q, m).collect()] == [1]
    with pytest.raises(Exception, match="reference not found"):
        intervals.select_manifests(q, m, strict=True).collect()


def test_query_on_a_tile_boundary(spark):
    m = spark.createDataFrame([(1, "S", "c", 10, 300, 64, 128)], "manifest_id long, sample string, contig string, start long, end long, window_size long, bucket_span long")
    tiles = intervals.tile_references(m).select("manifest_id", "bucket_id", "core_start", "core_end")
    assert [(r.core_start, r.core_end) for r in tiles.orderBy("core_start").collect()] == [(10, 64), (64, 128), (128, 192), (192, 256), (256, 300)]
    q = spark.createDataFrame([(1, "S", "c", 64, 128), (2, "S", "c", 127, 129), (3, "S", "c", 500, 600)], "query_id long, sample string, contig string, q_start long, q_end long")
    found = intervals.look_up_tiles(intervals.select_manifests(q, m), tiles)
    assert sorted((r.query_id, r.core_start) for r in found.collect()) == [(1, 64), (2, 64), (2, 128)]


def greedy(ranges, gap, cap):
    out = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1] + gap and max(out[-1][1], e) - out[-1][0] <= cap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_coalescing_against_a_fold(spark):
    rng = random.Random(1)
    data = {k: [(s := rng.randrange(400), s + rng.randrange(1, 40)) for _ in range(30)] for k in range(12)}
    df = spark.createDataFrame([(k, s, e) for k, v in data.items() for s, e in v], "key long, start long, end long")
    plain = rows_of(coalesced(df, ["key"], "start", "end", 5).select("key", "start", "end"), ["key", "start", "end"])
    assert plain == sorted(((k, *r) for k, v in data.items() for r in greedy(v, 5, 10**9)), key=repr)
    capped = rows_of(intervals.coalesce_capped(df, ["key"], gap=5, cap=60).select("key", "start", "end"), ["key", "start", "end"])
    assert capped == sorted(((k, *r) for k, v in data.items() for r in greedy(v, 5, 60)), key=repr)


def test_limit_ranges(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 5, 6), (1, 7, 8), (1, 20, 21)], "key long, start long, end long")
    assert rows_of(intervals.limit_ranges(df, ["key"], 2), ["start", "end", "members"]) == [(0, 8, 3), (20, 21, 1)]


def test_palindromic_walk_counts_twice_and_reference_once(spark):
    w = spark.createDataFrame([(1, 1, [2, 4, 3]), (1, 2, [2, 4]), (1, 3, [2, 4]), (1, 4, [5, 3])], "tile_id long, path_id long, walk array<long>")
    got = {tuple(r.walk): r.weight for r in walks.weighted_walks(w).collect()}
    assert got[2, 4] == 3  # twice forward, and [5, 3] is its mirror image
    assert got[2, 4, 3] == 1 and got[2, 5, 3] == 1  # both strands of a palindromic walk are canonical
    ref = spark.createDataFrame([(1, [2, 4])], "tile_id long, walk array<long>")
    assert {tuple(r.walk): r.weight for r in walks.weighted_walks(w, ref).collect()}[2, 4] == 2


def test_unknown_path_is_an_error(spark):
    members = spark.createDataFrame([(1,), (2,)], "path_id long")
    catalog = spark.createDataFrame([(1, "a")], "path_id long, canonical_name string")
    with pytest.raises(Exception, match="path missing"):
        walks.referenced_paths(members, catalog).collect()


def test_conflicting_nodes_are_an_error(spark):
    nodes = spark.createDataFrame([(1, "A"), (1, "A"), (2, "C"), (2, "G")], "node_id long, seq string")
    with pytest.raises(Exception, match="conflicting"):
        graph.merged_nodes(nodes).collect()
    assert graph.merged_nodes(nodes.where("node_id = 1")).collect() == [(1, "A")]


def shortest(nodes, edges, seeds, context):
    import heapq

    arcs = {}
    for a, b in edges:
        for x, y in ((a, b), (b ^ 1, a ^ 1)):
            arcs.setdefault((x >> 1, 0 if x & 1 else 1), set()).add((y >> 1, 1 if y & 1 else 0))
    best = {}
    heap = [(d, n, s) for n, s, d in seeds]
    while heap:
        d, n, s = heapq.heappop(heap)
        if best.get((n, s), 1 << 60) <= d:
            continue
        best[n, s] = d
        for (m, t), c in [(x, 1) for x in arcs.get((n, s), ())] + [((n, 1 - s), max(0, nodes[n] - 1))]:
            if d + c <= context:
                heapq.heappush(heap, (d + c, m, t))
    return best


def test_context_expansion_against_dijkstra(spark):
    rng = random.Random(4)
    nodes = {n: rng.randrange(1, 5) for n in range(1, 25)}
    edges = {(rng.randrange(2, 50), rng.randrange(2, 50)) for _ in range(40)}
    seeds = [(1, 0, 0), (1, 1, 50), (7, 1, 2)]
    got = graph.expand_context(
        spark.createDataFrame([(1, *s) for s in seeds], "key long, node_id long, side int, distance long"),
        spark.createDataFrame([(n, "A" * k) for n, k in nodes.items()], "node_id long, seq string"),
        spark.createDataFrame(list(edges), "from_handle long, to_handle long"), 6,
    )
    assert {(r.node_id, r.side): r.distance for r in got.collect()} == shortest(nodes, edges, seeds, 6)


def test_core_grows_over_selected_neighbours(spark):
    rows = [(1, i, i in (4, 5), True) for i in (2, 3, 4, 5, 6, 8)]
    df = spark.createDataFrame(rows, "key long, ord long, core boolean, selected boolean")
    assert sorted(r.ord for r in graph.grown_core(df).collect()) == [2, 3, 4, 5, 6]


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_level_choice_is_greedy_and_stable():
    series = [{"manifest_id": m, "level": lv, "bins": max(1, 16 >> (2 * lv))} for m in (1, 2) for lv in range(3)]
    assert choose_levels(series, 100) == {1: 0, 2: 0}
    assert choose_levels(series, 20) == {1: 1, 2: 0}
    assert choose_levels(series, 1) == {1: 2, 2: 2}


def test_bins_must_not_be_crossed(spark):
    t = spark.createDataFrame([(1, 250, 260, 10, 1, 1, 1, 1)], "manifest_id long, core_start long, core_end long, covered_bases long, tile_count long, encoded_bytes long, decoded_bytes long, node_records long")
    with pytest.raises(Exception, match="crosses"):
        summary.base_bins(t, 256).collect()


def test_two_rank_rules_differ(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, v double")
    assert measures.distribution_ceil(df, ["k"], "v").head()["p50"] == 5.0
    assert measures.distribution_nearest_rank(df, ["k"], "v").head()["p50"] == 4.0


def test_pareto_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(20), rng.randrange(20)) for i in range(200)]
    got = {r.id for r in measures.pareto_frontier(spark.createDataFrame(rows, "id long, a long, b long"), "id", ["a", "b"]).collect()}
    assert got == {i for i, a, b in rows if not any(c <= a and d <= b and (c < a or d < b) for _, c, d in rows)}


def test_truncation_flag_when_limit_equals_hits(spark):
    rec = spark.createDataFrame([(f"n{i}", f"n{i}", f"s{i}", "S", "c", i, i + 1) for i in range(3)], "matched_name string, display_name string, stable_id string, sample string, contig string, start long, end long")
    index = loci.index(rec)
    assert [r.truncated for r in loci.search(index, "N", prefix=True, limit=3).collect()] == [False] * 3
    assert [r.truncated for r in loci.search(index, "n", prefix=True, limit=2).collect()] == [True] * 2


def test_index_is_written_once(spark, tmp_path):
    rec = spark.createDataFrame([("x", "x", "s", "S", "c", 0, 1)], "matched_name string, display_name string, stable_id string, sample string, contig string, start long, end long")
    loci.write_index(loci.index(rec), str(tmp_path / "i"), 2)
    with pytest.raises(Exception, match="already exists"):
        loci.write_index(loci.index(rec), str(tmp_path / "i"), 2)


def test_unknown_strand_is_an_error(spark):
    lines = spark.createDataFrame([("c\ts\tgene\t5\t9\t.\t*\t.\tID=a",)], "value string")
    with pytest.raises(Exception, match="strand"):
        loci.parse_gff(lines).collect()


def test_centred_region_stays_inside(spark):
    left, right = display.centred_region(F.lit(5), F.lit(100), F.lit(0), F.lit(60))
    assert (value(spark, left), value(spark, right)) == (0, 60)
