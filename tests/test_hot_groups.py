"""Order statistics, frontiers, hash trees and graph checks with one hot key, against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.operators import digests, graph, intervals, measures, validation
from rangeloom.operators.ordered import in_blocks, neighbour


@pytest.mark.parametrize("kind", ["long", "double"])
def test_order_statistics_of_a_hot_group(spark, monkeypatch, kind):
    """Many more values than are sorted at once: narrowed over several passes, outliers and repeats and null keys included."""
    monkeypatch.setattr(measures, "SORTED_VALUES", 16)
    monkeypatch.setattr(measures, "BINS", 8)
    rng = random.Random(9)
    cast = int if kind == "long" else float
    rows = [(rng.choice(["hot", "hot", "hot", None]), cast(rng.choice([rng.randrange(900), rng.randrange(10**9), 7, -(10**14)]))) for _ in range(3000)]
    rows += [("one", cast(5))] * 3 + [("hot", None)]
    df = spark.createDataFrame(rows, f"k string, v {kind}").repartition(6)
    got = {r.k: r for r in measures.distribution_ceil(df, ["k"], "v", (1, 50, 99)).collect()}
    for key in ("hot", None, "one"):
        held = sorted(v for k, v in rows if k == key and v is not None)
        at = [held[-(-(len(held) - 1) * p // 100)] for p in (1, 50, 99)]
        assert (got[key].n, got[key].p1, got[key].p50, got[key].p99, got[key].min, got[key].max) == (len(held), *at, held[0], held[-1])


@pytest.mark.parametrize("kind", ["anticorrelated", "random", "few values", "one"])
def test_frontier(spark, kind):
    rng = np.random.default_rng(4)
    n = 1 if kind == "one" else 1500
    x = rng.random((n, 3))
    if kind == "anticorrelated":
        x[:, 2] = 2 - x[:, 0] - x[:, 1]
    if kind == "few values":
        x = np.floor(x * 4)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(9)
    got = {r.id for r in measures.pareto_frontier(df, "id", ["a", "b", "c"], cells=4).collect()}
    assert got == {i for i in range(n) if not ((x <= x[i]).all(axis=1) & (x < x[i]).any(axis=1)).any()}
    assert measures.pareto_frontier(df.limit(0), "id", ["a", "b"]).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_tree_digest_tells_order_and_depth(spark):
    rows = [("hot", i, f"v{i}") for i in range(0, 3000, 3)] + [("cold", 70_000, "x")]

    def digest_of(rows):
        df = spark.createDataFrame(rows, "k string, ord long, v string").repartition(5)
        return {r.k: (r.digest, r.leaves) for r in digests.tree_digest(df, ["k"], "ord", F.col("v")).collect()}

    def plain(rows):
        level = [(o, sha(f"leaf:{v}")) for o, v in rows]
        for name in ("node 1", "node 2", "node 3"):
            blocks = {}
            for at, h in sorted(level):
                blocks.setdefault(at // 256, []).append(h)
            level = [(b, sha(f"{name}:{len(hs)}:{','.join(hs)}")) for b, hs in blocks.items()]
        hs = [h for _, h in sorted(level)]
        return sha(f"top:{len(hs)}:{','.join(hs)}")

    sound = digest_of(rows)
    assert sound == {k: (plain([(o, v) for c, o, v in rows if c == k]), sum(c == k for c, _, _ in rows)) for k in ("hot", "cold")}
    swapped = [*rows[:5], ("hot", rows[6][1], rows[5][2]), ("hot", rows[5][1], rows[6][2]), *rows[7:]]
    assert digest_of(swapped)["hot"] != sound["hot"] and digest_of(swapped)["cold"] == sound["cold"]


def test_graph_faults_name_what_differs(spark):
    walks = {k: [[2, 4, 6], [7, 5, 3], [4, 6]] for k in range(6)}
    stored = {k: [list(w) for w in ws] for k, ws in walks.items()}
    del stored[1][2]
    stored[2][0][1] = 5
    stored[3].append([4, 6])
    stored[4][1] = [2, 4, 6]  # the same walk on the other strand
    del stored[5]
    df = lambda held: spark.createDataFrame([(k, w) for k, ws in held.items() for w in ws], "key long, walk array<long>")
    edges = spark.createDataFrame([(k, a, b) for k in walks for a, b in ((2, 4), (4, 6))], "key long, from_handle long, to_handle long")
    got = {r.key: (r.walks, r.first_walk, r.weight_source, r.weight_stored, r.edges_missing, r.edges_extra) for r in validation.graph_faults(df(walks), df(stored), edges).collect()}
    assert got == {
        1: (1, "4,6", 1, 0, 0, 0), 2: (2, "2,4,6", 2, 1, 0, 2), 3: (1, "4,6", 1, 2, 0, 0), 5: (2, "2,4,6", 2, 0, 2, 0),
    }


def test_neighbours_across_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", None]), i, rng.choice([None, i * 7])) for i in sorted(rng.sample(range(10**6), 700))]
    df = in_blocks(spark.createDataFrame(rows, "k string, at long, v long").repartition(5), "at")
    got = {(r.k, r.at): (r.p, r.n) for r in neighbour(neighbour(df, ["k"], ["at"], "v", "p"), ["k"], ["at"], "v", "n", after=True).collect()}
    for key in ("hot", None):
        held = [(a, v) for k, a, v in rows if k == key]
        assert all(got[key, a] == (held[i - 1][1] if i else None, held[i + 1][1] if i + 1 < len(held) else None) for i, (a, _) in enumerate(held))


@pytest.mark.parametrize("most", [1, 2, 9, 10**4])
def test_fewest_ranges_of_a_hot_key(spark, most):
    rng = random.Random(most)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([1, 2, 2, 5, 40])
        rows.append(("hot" if i % 20 else None, at, at + 1))
        at += 1
    got = sorted((str(r.k), r.start, r.end, r.members) for r in intervals.limit_ranges(spark.createDataFrame(rows, "k string, start long, end long").repartition(6), ["k"], most).collect())
    expected = []
    for key in ("hot", None):
        held = [(s, e) for k, s, e in rows if k == key]
        gaps = sorted(range(1, len(held)), key=lambda i: (held[i][0] - held[i - 1][1], i))
        cuts = sorted(gaps[len(gaps) - most + 1 :] if most > 1 else [])
        for a, b in zip([0, *cuts], [*cuts, len(held)]):
            expected.append((str(key), held[a][0], held[b - 1][1], b - a))
    assert got == sorted(expected)


def test_exclusive_length_and_chains_of_a_hot_key(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["hot", "hot", None]), s := rng.randrange(4000), s + rng.randrange(1, 12), rng.random() < 0.5) for _ in range(500)]
    got = {r.k: r.exclusive for r in intervals.exclusive_union(spark.createDataFrame(rows, "k string, start long, end long, w boolean"), ["k"], F.col("w")).collect()}
    for key in ("hot", None):
        cover = lambda w: {x for k, s, e, m in rows if k == key and m == w for x in range(s, e)}  # noqa: E731, B023
        assert got[key] == len(cover(True) - cover(False))
    visits = [("hot", i * 11, rng.choice([0, 0, 0, 1, None])) for i in range(800)] + [(None, 5, 1)]
    held = graph.collapsed_chains(spark.createDataFrame(visits, "k string, ord long, chain int").repartition(5), ["k"], most=3).collect()
    run, place, expected, before = 0, 0, {}, object()
    for _, at, chain in visits[:-1]:
        run, place = (run, place + 1) if chain == before else (run + 1, 0)
        before, expected[at] = chain, (run, place // 3)
    assert {r.ord: (r.run, r.part) for r in held if r.k} == expected


def test_adaptive_windows_with_one_hot_cell(spark):
    """A third of all rows in one cell, negative keys, null keys and a window that ends exactly at the cap."""
    rng = random.Random(13)
    keys = [rng.randrange(-3000, 6000) for _ in range(1500)] + [77] * 800 + [5000 + i for i in range(100)] + [None] * 5
    cap = 150

    def split(start, width, depth):
        n = sum(1 for k in keys if k is not None and start <= k < start + width)
        if n > cap and width > 64:
            return split(start, width // 2, depth + 1) + split(start + width // 2, width // 2, depth + 1)
        return [(start, start + width, depth, n)] if n else []

    expected = [w for start in range(-3072, 6144, 1024) for w in split(start, 1024, 0)]
    df = spark.createDataFrame([(k,) for k in keys], "key long").repartition(6)
    got = [tuple(r) for r in intervals.adaptive_windows(df, "key", cap=cap).select("start", "end", "depth", "rows").collect()]
    assert sorted(got) == sorted(expected) and any(n > cap for *_, n in got)
    assert intervals.adaptive_windows(df.limit(0), "key", cap=cap).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        intervals.adaptive_windows(df, "key", cap=cap, narrowest=100)
