"""The graph queries over every region and all haplotype edges, against brute force on the smallest tables."""

import heapq
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from helpers import DATA

from rangeloom.jobs import catalogue, graph_queries, walk_queries
from rangeloom.operators import graph, regions
from rangeloom.sources import tables as T


def flipped(a, b):
    return b ^ 1, a ^ 1


def canonical(a, b):
    keep = (b // 2 > a // 2 or (b // 2 == a // 2 and b % 2 == 0)) if a % 2 else b // 2 >= a // 2
    return (a, b) if keep else flipped(a, b)


@pytest.fixture(scope="module")
def whole():
    """Reference edges, all edges, visits and regions, in plain Python."""
    part = sorted(pq.read_table(f"{DATA}/part.parquet").to_pylist(), key=lambda r: r["p_partkey"])
    line = pq.read_table(f"{DATA}/lineitem.parquet").to_pylist()
    length = {p["p_partkey"] + 1: 1 + p["p_size"] % 17 for p in part}
    contigs, orders, visits, places = defaultdict(list), defaultdict(list), defaultdict(list), {}
    for p in part:
        places[p["p_partkey"]] = p["p_brand"], len(contigs[p["p_brand"]])
        contigs[p["p_brand"]].append(2 * (p["p_partkey"] + 1))
    at = {}
    for r in sorted(line, key=lambda r: (r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["l_extendedprice"])):
        contig, place = at.get(r["l_orderkey"]) or places[r["l_partkey"]]
        if r["l_orderkey"] in at:
            place += 1 + (r["l_partkey"] + r["l_suppkey"]) % 3
        at[r["l_orderkey"]] = contig, place
        orders[r["l_orderkey"]].append(contigs[contig][place % len(contigs[contig])] + (int(r["l_quantity"]) % 7 == 0))
    ref = {canonical(a, b) for w in contigs.values() for a, b in zip(w, w[1:])}
    alt = {canonical(a, b) for w in orders.values() for a, b in zip(w, w[1:])}
    for contig, walk in contigs.items():
        at = 100 * len(contig) + 7
        for h in walk:
            visits[contig].append((h, at, at + length[h // 2]))
            at += length[h // 2]
    asked = {}
    for s in pq.read_table(f"{DATA}/supplier.parquet").to_pylist():
        k = s["s_suppkey"]
        contig = f"Brand#{k % 25 + 1}"
        if contig in visits:
            first, last = visits[contig][0][1], visits[contig][-1][2]
            start = first + k * 7919 % (last - first)
            asked[k] = contig, start, start + 1 + k * 13 % 200
    return ref, alt, length, visits, asked, orders


@pytest.fixture(scope="module")
def contexts(whole):
    """query -> (node, side) -> distance, by Dijkstra."""
    ref, alt, length, visits, asked, _ = whole
    moves = defaultdict(set)
    for e in ref | alt:
        for a, b in (e, flipped(*e)):
            moves[a // 2, 1 - a % 2].add((b // 2, b % 2, 1))
    for n, size in length.items():
        for side in (0, 1):
            moves[n, side].add((n, 1 - side, max(0, size - 1)))
    found = {}
    for q, (contig, start, end) in asked.items():
        best, heap = {}, []
        for h, s, e in visits[contig]:
            if s < end and e > start:
                heap += [(max(s, start) - s, h // 2, h % 2), (max(0, e - min(e, end) - 1), h // 2, 1 - h % 2)]
        heapq.heapify(heap)
        while heap:
            d, n, side = heapq.heappop(heap)
            if (n, side) not in best:
                best[n, side] = d
                for m, t, c in moves[n, side]:
                    if d + c <= graph_queries.CONTEXT and (m, t) not in best:
                        heapq.heappush(heap, (d + c, m, t))
        found[q] = best
    return found


def run(spark, name):
    return catalogue.queries()[name](spark, DATA)


def test_context_of_every_region(spark, contexts, whole):
    assert len(contexts) == spark.read.parquet(f"{DATA}/supplier.parquet").count()
    got = {(r.query_id, r.node_id, r.side): r.distance for r in run(spark, "context_nodes").collect()}
    assert got == {(q, n, side): d for q, best in contexts.items() for (n, side), d in best.items()}


def test_nodes_and_edges_of_every_region(spark, contexts, whole):
    nodes = {q: {n for n, _ in best} for q, best in contexts.items()}
    got = [(r.query_id, r.node_id, len(r.seq)) for r in run(spark, "region_nodes").collect()]
    assert sorted(got) == sorted((q, n, whole[2][n]) for q, held in nodes.items() for n in held)
    got = [tuple(r) for r in run(spark, "region_edges").select("query_id", "from_handle", "to_handle").collect()]
    assert sorted(got) == sorted((q, a, b) for q, held in nodes.items() for a, b in whole[0] | whole[1] if a // 2 in held and b // 2 in held)


def test_walk_of_every_region(spark, contexts, whole):
    expected = []
    for q, (contig, start, end) in whole[4].items():
        walk, held = whole[3][contig], {n for n, _ in contexts[q]}
        core = [i for i, (_, s, e) in enumerate(walk) if s < end and e > start]
        first, last = core[0], core[-1]
        while first and walk[first - 1][0] // 2 in held:
            first -= 1
        while last + 1 < len(walk) and walk[last + 1][0] // 2 in held:
            last += 1
        expected += [(q, *v) for v in walk[first : last + 1]]
    assert sorted(tuple(r) for r in run(spark, "region_walk").select("query_id", "handle", "start_pos", "end_pos").collect()) == sorted(expected)


def test_classes_of_all_edges(spark, whole):
    ref, alt, length, *_ = whole
    long = {n for n, size in length.items() if size > 4}

    def kind(a, b):
        return "reference" if (a, b) in ref else "inversion" if a % 2 != b % 2 else "deletion" if {a // 2, b // 2} <= long else "alternate"

    got = {(r.from_handle, r.to_handle): r.kind for r in run(spark, "edge_classes").collect()}
    assert got == {(a, b): kind(a, b) for a, b in ref | alt}


@pytest.mark.parametrize(("context", "width"), [(0, 1), (5, 1), (9, 2), (8, 3), (6, 4)])
def test_context_by_buckets_of_any_width(spark, context, width):
    """Against Dijkstra on a random graph with nodes of one base, loops, hairpins and far seeds."""
    rng = random.Random(context * 31 + width)
    length = {n: rng.choice([1, 1, 2, 5, 40]) for n in range(2, 60)}
    edges = {canonical(2 * rng.choice(list(length)) + rng.randrange(2), 2 * rng.choice(list(length)) + rng.randrange(2)) for _ in range(110)}
    seeds = [(k, rng.randrange(2, 60), rng.randrange(2), rng.randrange(0, 25)) for k in range(12) for _ in range(3)]
    moves = defaultdict(set)
    for e in edges:
        for a, b in (e, flipped(*e)):
            moves[a // 2, 1 - a % 2].add((b // 2, b % 2, 1))
    for n, size in length.items():
        for side in (0, 1):
            moves[n, side].add((n, 1 - side, size - 1))
    expected = {}
    for key in range(12):
        best, heap = {}, sorted((d, n, side) for k, n, side, d in seeds if k == key)
        while heap:
            d, n, side = heapq.heappop(heap)
            if (n, side) not in best:
                best[n, side] = d
                for m, t, c in moves[n, side]:
                    if d + c <= context:
                        heapq.heappush(heap, (d + c, m, t))
        expected |= {(key, n, side): d for (n, side), d in best.items()}
    got = graph.expand_context(
        spark.createDataFrame(seeds, "key long, node_id long, side int, distance long"), spark.createDataFrame([(n, "A" * k) for n, k in length.items()], "node_id long, seq string"),
        spark.createDataFrame(list(edges), "from_handle long, to_handle long"), context, width=width,
    ).collect()
    assert len(got) == len(expected) and {(r.key, r.node_id, r.side): r.distance for r in got} == expected


def strands(walk):
    for turned in (False, True):
        w = [h ^ 1 for h in reversed(walk)] if turned else walk
        if (w[0] % 2 == 0) if w[0] % 2 == w[-1] % 2 else canonical(w[0], w[-1]) == (w[0], w[-1]):
            yield turned, tuple(w)


def test_walks_and_names_of_every_region(spark, contexts, whole):
    _, _, _, visits, asked, orders = whole
    contigs = {-i - 1: [h for h, _, _ in visits[c]] for i, c in enumerate(sorted(visits))}
    weights, names = Counter(), Counter()
    for q, best in contexts.items():
        held = {n for n, _ in best}
        for path, walk in (orders | contigs).items():
            run = []
            for h in [*walk, None]:
                if h is not None and h // 2 in held:
                    run.append(h)
                    continue
                for turned, w in strands(run) if run else ():
                    weights[q, w] += 1
                    names[q, w, path, turned] += 1
                run = []
    own = {}
    for r in run_rows(spark, "region_walk"):
        own.setdefault(r.query_id, []).append((r.ord, r.handle))
    for q, steps in own.items():
        for _, w in strands([h for _, h in sorted(steps)]):
            weights[q, w] -= 1
    parsed = lambda text: tuple(map(int, text.split(",")))
    assert {(r.query_id, parsed(r.walk)): r.weight for r in run_rows(spark, "region_walks")} == {k: n for k, n in weights.items() if n}
    found = {(r.query_id, parsed(r.walk), r.path_id, r.is_reversed): r.multiplicity for r in run_rows(spark, "region_members")}
    assert found == dict(names)


def run_rows(spark, name):
    return run(spark, name).collect()


def test_stitched_runs_with_borders_on_every_node(spark):
    """Tiles of one or a few nodes, overlapping or not, and a path that comes back: the same runs as without tiles."""
    rng = random.Random(2)
    walks = [(p, i, 2 * rng.randrange(2, 30) + rng.randrange(2)) for p in range(12) for i in range(1, rng.randrange(2, 60))]
    visits = spark.createDataFrame([(p, i, h, h // 2) for p, i, h in walks], "path_id long, ord long, handle long, node_id long")
    tiles = spark.createDataFrame([(n // 3 + d, n) for n in range(2, 30) for d in (0, 1) if d == 0 or n % 2], "tile_id long, node_id long").distinct()
    chosen = spark.createDataFrame([(k, n) for k in range(5) for n in range(2, 30) if rng.random() < 0.7], "key long, node_id long")
    under = chosen.select("key").distinct().crossJoin(tiles.select("tile_id").distinct())
    direct = regions.region_runs(regions.region_visits(chosen, visits))
    stitched = regions.stitched_runs(regions.tile_pieces(tiles, visits), under, chosen)
    assert sorted(map(tuple, stitched.collect())) == sorted(map(tuple, direct.collect()))


def test_kinds_of_components(spark):
    members = spark.createDataFrame([(1, 1, False), (1, 2, False), (5, 5, True), (6, 6, False), (8, 8, False)], "component long, node_id long, reverse boolean")
    links = spark.createDataFrame([(1, 2), (1, 100), (2, 101), (5, 100), (101, 6), (6, 140), (5, 5)], "a long, b long")
    reference = spark.createDataFrame([(n, n - 100) for n in range(100, 150)], "node_id long, coordinate long")
    got = {r.component: (r.kind, r.nodes, r.anchors, r.anchor_start, r.anchor_end, r.direction) for r in regions.component_anchors(members, links, reference).collect()}
    assert got == {1: ("insertion", 2, 2, 0, 1, 1), 5: ("inversion", 1, 1, 0, 0, 1), 6: ("alternate", 1, 2, 1, 40, -1), 8: ("unanchored", 1, 0, None, None, -1)}


def test_every_list_and_spread_regions(spark):
    assert walk_queries.path_by_ids_all(spark, DATA).count() == spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    big = DATA.replace("sf0.001", "sf0.1")
    ends = {r.contig: (r.start, r.end) for r in T.manifests(spark, big).collect()}
    at = [(r.q_start - ends[r.contig][0]) / (ends[r.contig][1] - ends[r.contig][0]) for r in T.region_queries(spark, big).collect()]
    assert len(at) == 1000 and {int(10 * x) for x in at} == set(range(10))
