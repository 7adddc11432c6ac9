"""Checks, written archives, level choice, blocks of ordered operators and progressive streams on small inputs."""

import random

import pytest
from helpers import DATA, choose_levels
from pyspark.sql import functions as F

from rangeloom.operators import intervals, measures, summary, validation
from rangeloom.operators.ordered import in_blocks, islands
from rangeloom.sources import archive
from rangeloom.streaming.tiles import ProgressiveQuery


def test_levels_are_those_of_the_greedy_choice(spark):
    rng = random.Random(4)
    rows = []
    for view in range(40):
        for m in range(rng.randrange(1, 6)):
            bins = rng.randrange(1, 40)
            for level in range(rng.randrange(1, 6)):
                rows.append((view, m, level, bins))
                bins = max(1, bins - rng.choice([0, 1, 1, 3, bins // 2, bins - 1]))
    df = spark.createDataFrame(rows, "view int, manifest_id long, level int, bins long")
    got = {}
    for r in summary.levels_within(df, ["view"], 30).collect():
        got.setdefault(r.view, {})[r.manifest_id] = r.level
    for view in range(40):
        assert got[view] == choose_levels([{"manifest_id": m, "level": lv, "bins": n} for v, m, lv, n in rows if v == view], 30)


def test_one_hot_key_over_many_blocks(spark):
    """A key with nearly all intervals, nulls in the key, and repeated rows: as plain Python has it."""
    rng = random.Random(8)
    rows = [("hot" if i % 50 else None, s := rng.randrange(5000), s + rng.randrange(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, start long, end long").repartition(12)
    assert df.transform(lambda d: in_blocks(d, "start")).select("_block").distinct().count() > 500
    got = sorted((str(r.k), r.start, r.end, r.island) for r in islands(df, ["k"], "start", "end", 1).collect())
    expected, rounds, overlaps = [], [], set()
    for key in ("hot", None):
        reach, n, round_ = None, 0, 0
        for _, s, e in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            n += reach is None or s > reach + 1
            round_ += reach is None or s >= reach
            reach = max(reach or e, e)
            expected.append((str(key), s, e, n))
            rounds.append((str(key), s, e, round_))
        reach = None
        for s, e in sorted({r[1:] for r in rows if r[0] == key}):
            if reach is not None and s < reach:
                overlaps.add((str(key), s, e))
            reach = max(reach or e, e)
    assert got == sorted(expected)
    assert sorted((str(r.k), r.start, r.end, r.round) for r in measures.request_rounds(df, ["k"]).collect()) == sorted(rounds)
    assert {(str(r.k), r.start, r.end) for r in intervals.overlap_violations(df, ["k"]).collect()} == overlaps
    assert islands(df.limit(0), ["k"], "start", "end").count() == 0


def test_overlap_join_meets_each_pair_once(spark):
    rng = random.Random(3)
    make = lambda n: [(i, rng.choice("ab"), s := rng.randrange(-500, 9000), s + rng.randrange(0, 3000)) for i in range(n)]
    queries, spans = make(40), make(60)
    q, v = spark.createDataFrame(queries, "q long, contig string, q_start long, q_end long"), spark.createDataFrame(spans, "v long, contig string, start long, end long")
    got = sorted((r.q, r.v) for r in intervals.overlap_join(q, v, ["contig"], block=256).collect())
    assert got == sorted((a[0], b[0]) for a in queries for b in spans if a[1] == b[1] and a[2] < a[3] and b[2] < b[3] and b[2] < a[3] and b[3] > a[2])


def test_an_archive_is_published_once(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("tile_index"), (F.col("id") % 3).alias("manifest_id"))
    path = str(tmp_path / "archive")
    archive.publish({"tiles": (rows, ["manifest_id"])}, path)
    back = archive.load(spark, path, "tiles", "tile_index long, manifest_id long")
    assert back.where("manifest_id = 2").count() == 6 and {p.name for p in tmp_path.iterdir()} == {"archive"}
    with pytest.raises(FileExistsError):
        archive.publish({"tiles": (rows, ["manifest_id"])}, path)
    with pytest.raises(Exception, match="no_such"):
        archive.publish({"tiles": (rows, ["no_such"])}, f"{path}-2")
    assert {p.name for p in tmp_path.iterdir()} == {"archive"}


def test_query_problems(spark):
    rows = [("S", "c", 0, 5, None, None), ("", "c", 0, 5, 0, "empty name"), (None, "c", 0, 5, 0, "empty name"), ("S", "c", -1, 5, 0, "not a safe integer"), ("S", "c", 5, 5, 0, "empty interval"), ("S", "c", 0, 1 << 53, 0, "not a safe integer"), ("S", "c", 0, 5, 100, None), ("S", "c", 0, 5, 101, "context too wide"), ("S", "c", None, 5, 1, "not a safe integer")]
    df = spark.createDataFrame(rows, "s string, c string, a long, b long, x long, want string")
    got = df.select("want", validation.query_problem(*[F.col(c) for c in "scabx"]).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_xorshift_is_the_generator(spark):
    x, seeds = [], [1, 42, (1 << 63) - 1]
    for v in seeds:
        v ^= v << 13 & (1 << 64) - 1
        v ^= v >> 7
        v ^= v << 17 & (1 << 64) - 1
        x.append((v, v % 1000))
    df = spark.createDataFrame([(s,) for s in seeds], "s long").select(validation.xorshift64(F.col("s")).alias("v"))
    assert [(r.v % (1 << 64), r.m) for r in df.select("v", validation.unsigned_mod(F.col("v"), 1000).alias("m")).collect()] == x


def test_progressive_query_drops_stale_batches(spark, tmp_path):
    """Only the query started last reaches the receiver, also when an older one is still running."""
    folder = tmp_path / "in"
    spark.read.parquet(f"{DATA}/nation.parquet").repartition(4).write.parquet(str(folder))
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    seen = []
    query = ProgressiveQuery(lambda batch, number: seen.append((query.generation, batch.count())))
    first = query.start(stream, str(tmp_path / "one"))
    second = query.start(stream, str(tmp_path / "two"))
    second.awaitTermination()
    assert not first.isActive and first is not second
    latest = max(g for g, _ in seen)
    assert sum(n for g, n in seen if g == latest) == 25
    query.cancel()
    count = len(seen)
    assert query.active is None and len(seen) == count
