"""Lists told by their links: ranks, names, cycles, heads, and walks rebuilt from records."""

import random

import pytest
from helpers import DATA
from pyspark.sql import functions as F

from rangeloom.jobs import walk_queries
from rangeloom.operators import chains, intervals


def links_of(spark, lists):
    rows = [(a, b) for one in lists for a, b in zip(one, [*one[1:], None])]
    return spark.createDataFrame(rows, "id long, next long").repartition(5)


def test_ranks_of_long_and_short_lists(spark):
    rng = random.Random(5)
    ids = list(range(3000))
    rng.shuffle(ids)
    cuts = [0, 1, 2, 7, 60, 61, 3000]
    lists = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
    anchors = [(x, i) for i, one in enumerate(lists) for j, x in enumerate(one) if j == rng.randrange(len(one)) or rng.random() < 0.06 or len(one) == 1 or j == 3]
    anchors += [(lists[i][rng.randrange(len(lists[i]))], i) for i in range(len(lists))] + [(one[-1], i) for i, one in enumerate(lists) if i % 2]
    got = {r.id: (r.end, r["rank"], r.name) for r in chains.ranked_lists(links_of(spark, lists), spark.createDataFrame(anchors, "id long, name long")).collect()}
    assert got == {x: (one[-1], len(one) - 1 - j, i) for i, one in enumerate(lists) for j, x in enumerate(one)}


@pytest.mark.parametrize("anchored", [True, False])
def test_a_cycle_is_told(spark, anchored):
    links = spark.createDataFrame([(i, (i + 1) % 9) for i in range(9)] + [(20, 21), (21, None)], "id long, next long")
    anchors = spark.createDataFrame([(21, 1)] + [(3, 2)] * anchored, "id long, name long")
    with pytest.raises(ValueError, match="cycle"):
        chains.ranked_lists(links, anchors, max_steps=64)


def test_lists_without_or_with_two_names(spark):
    links = links_of(spark, [[1, 2, 3], [4, 5, 6]])
    for anchors in ([(2, 1)], [(2, 1), (4, 2), (6, 3)]):
        with pytest.raises(Exception, match="anchor"):
            chains.ranked_lists(links, spark.createDataFrame(anchors, "id long, name long")).collect()


def test_heads_that_jumps_reach(spark):
    rng = random.Random(6)
    jump = {i: rng.randrange(i + 1, i + 9) for i in range(1000)}
    df = spark.createDataFrame([(i, n if n < 1000 else None) for i, n in jump.items()], "id long, next long")
    at, expected = 3, {700}
    for start in (3, 700):
        at = start
        while at < 1000:
            expected.add(at)
            at = jump[at]
    assert {r.id for r in chains.reached_heads(spark.createDataFrame([(3,), (700,)], "id long"), df).collect()} == expected


def greedy(ranges, gap, cap):
    out = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1] + gap and max(out[-1][1], e) - out[-1][0] <= cap:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2] += 1
        else:
            out.append([s, e, 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize(("spread", "gap", "cap"), [(3000, 0, 40), (3000, 5, 17), (200, 2, 6), (10**7, 100, 5000), (3000, 3, 10**6)])
def test_capped_merging_is_the_greedy_one(spark, spread, gap, cap):
    """One island over many partitions, null keys, repeats, and ranges longer than the cap."""
    rng = random.Random(spread + cap)
    rows = [("hot" if i % 9 else rng.choice([None, "cold"]), s := rng.randrange(spread), s + rng.choice([0, 1, 3, 9, cap, cap + 1, 30])) for i in range(900)]
    rows += rows[:60]
    df = spark.createDataFrame(rows, "k string, start long, end long").repartition(7)
    got = sorted((str(r.k), r.start, r.end, r.members) for r in intervals.coalesce_capped(df, ["k"], gap=gap, cap=cap, block_rows=20).collect())
    assert got == sorted((str(k), *x) for k in ("hot", None, "cold") for x in greedy([r[1:] for r in rows if r[0] == k], gap, cap))


def test_walks_from_records_are_the_stored_ones(spark):
    stored = sorted((r.tile_id, r.path_id, tuple(r.walk)) for r in walk_queries.event_walks(spark, DATA).collect())
    rebuilt = chains.walks_from_records(*walk_queries.event_records(spark, DATA), ["tile_id"])
    assert sorted((r.tile_id, r.path_id, tuple(r.walk)) for r in rebuilt.collect()) == stored
    records, anchors = walk_queries.event_records(spark, DATA)
    assert "ord" not in records.columns and anchors.count() < records.count()
    turned = records.withColumn("next_handle", F.coalesce("next_handle", "handle")).withColumn("next_occurrence", F.coalesce("next_occurrence", "occurrence"))
    with pytest.raises(ValueError, match="cycle"):
        chains.walks_from_records(turned, anchors, ["tile_id"], max_steps=1 << 8)


def test_capped_merges_are_those_of_a_plain_scan(spark):
    """Long ranges that cover later islands, cuts by the cap, copies; and the jumps that are followed are the cuts alone."""
    for seed in range(2):
        rng = random.Random(seed)
        rows = []
        for k in (None, 1, 2):
            for _ in range(120):
                s = rng.randrange(0, 900)
                rows += [(k, s, s + rng.choice([1, 3, 9, 30, 200]))] * rng.choice([1, 1, 3])
        want = []
        for k in (None, 1, 2):
            held = sorted((s, e) for key, s, e in rows if key == k)
            at = None
            for s, e in held:
                if at and e - s <= 40 and at[1] - at[0] <= 40 and s <= at[1] + 4 and e <= at[0] + 40:
                    at[1], at[2] = max(at[1], e), at[2] + 1
                else:
                    at = [s, e, 1]
                    want.append((k, at))
        df = spark.createDataFrame(rows, "k int, start long, end long").repartition(5)
        for block_rows in (7, 20_000):
            got = sorted(((r.k, r.start, r.end, r.members) for r in intervals.coalesce_capped(df, ["k"], gap=4, cap=40, block_rows=block_rows).collect()), key=repr)
            assert got == sorted(((k, *m) for k, m in want), key=repr)


def test_capped_merges_follow_only_cuts(spark, monkeypatch):
    followed = []
    monkeypatch.setattr(intervals, "reached_heads", lambda heads, jumps: followed.append(jumps.count()) or chains.reached_heads(heads, jumps))
    df = spark.range(500).select(F.lit(1).alias("k"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + F.when(F.col("id") < 5, 100).otherwise(10)).alias("end"))
    got = sorted((r.start, r.end) for r in intervals.coalesce_capped(df, ["k"], gap=0, cap=250).collect())
    assert got == [(0, 200), (200, 400), (400, 510), *((i * 100, i * 100 + 10) for i in range(6, 500))]
    assert followed and max(followed) <= 6
