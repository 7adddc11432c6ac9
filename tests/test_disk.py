"""What written tables leave on the disk: no shuffle files, and of shared tables none of the steps to them."""

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rangeloom.operators import graph
from rangeloom.sources import scratch


@pytest.fixture
def shuffles(spark):
    def files():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {f for f in held.split() if "/shuffle_" in f and f.endswith(".data")}

    def left(before):
        for _ in range(50):
            if not (now := files() - before):
                break
            time.sleep(0.2)
        return now

    before = files()
    return lambda: left(before)


@pytest.fixture
def folders(spark):
    def held():
        return set(os.listdir(scratch.scratch_dir(spark).removeprefix("file://")))

    before = held()
    return lambda: held() - before


def test_shuffle_files_go_with_the_write(spark, shuffles):
    table = scratch.materialize(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.collect_list("id").alias("ids")), "grouped")
    assert not shuffles()
    assert table.agg(F.sum(F.size("ids"))).head()[0] == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_steps_of_a_shared_table_go(spark, tmp_path, shuffles, folders):
    spark.range(60).select((F.col("id") + 2).alias("node_id"), F.lit("AC").alias("seq")).write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    edges = nodes.where("node_id < 61").select((F.col("node_id") * 2).alias("from_handle"), (F.col("node_id") * 2 + 2).alias("to_handle"))
    seeds = spark.createDataFrame([(1, 30, 0, 0)], "key long, node_id long, side int, distance long")
    found = scratch.shared(spark, "context-of-one", [nodes], lambda: graph.expand_context(seeds, nodes, edges, 3))
    assert {(r.node_id, r.side): r.distance for r in found.collect()} == {(30, 0): 0, (30, 1): 1, (29, 1): 1, (29, 0): 2, (31, 0): 2, (28, 1): 3, (31, 1): 3}
    assert len(folders()) == 1 and Path(next(iter(folders()))).name.startswith("context-of-one")
    assert not shuffles()


def test_no_table_of_the_expansion_outgrows_its_moves(spark, monkeypatch):
    """Ways of two moves between all sides grow with the square of the degree; here it is 60."""
    written = {}

    def noted(df, name):
        table = scratch.materialize(df, name)
        written[name] = max(written.get(name, 0), table.select(F.sum(F.size("to")) if "to" in table.columns else F.count(F.lit(1))).head()[0] or 0)
        return table

    monkeypatch.setattr(graph, "materialize", noted)
    nodes = spark.range(2, 62).select(F.col("id").alias("node_id"), F.lit("AC").alias("seq"))
    edges = nodes.crossJoin(nodes.select(F.col("node_id").alias("to"))).where("node_id <= to").select((F.col("node_id") * 2).alias("from_handle"), (F.col("to") * 2).alias("to_handle"))
    seeds = spark.createDataFrame([(1, 30, 0, 0)], "key long, node_id long, side int, distance long")
    assert graph.expand_context(seeds, nodes, edges, 8).count() == 120
    assert max(written.values()) <= 2 * edges.count() + 2 * nodes.count()


def test_long_orders_keep_their_places(spark, tmp_path):
    """Lines of an order follow one another by number, repeats and all, over the end of the contig."""
    from rangeloom.sources import tables as T

    part = [(k, 3, f"Brand#{k % 2}") for k in range(1, 8)]
    lines = [(1, 7, 3, n, 1.0, 7.0 * (n % 2) + 1) for n in range(1, 9)] + [(2, 2, 1, 1, 1.0, 14.0)]
    spark.createDataFrame(part, "p_partkey long, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.path_id, r.ord, r.node_id, r.handle) for r in T.haplotype_walks(spark, str(tmp_path)).collect())
    odd = [1, 3, 5, 7]
    want = [(1, n, odd[(3 + 2 * (n - 1)) % 4] + 1) for n in range(1, 9)]
    assert [g[:3] for g in got] == [*want, (2, 1, 3)] and got[-1][3] == 7


def test_slices_deal_every_key_once(spark):
    rows = spark.range(1000).select((F.col("id") % 90).alias("key"))
    assert len(scratch.sliced(100, each=200)) == 1 and len(scratch.sliced(1000, each=200)) == 4 and len(scratch.sliced(500, each=200)) == 3
    parts = [{r.key for r in of(rows).distinct().collect()} for of in scratch.sliced(1000, each=200)]
    assert all(parts) and sum(map(len, parts)) == 90 and set().union(*parts) == set(range(90))


def test_verified_regions_are_cut_to_their_first_tile(spark, monkeypatch):
    """Tiles that overlap store a visit more than once; it is read once a region, so no more rows are dealt than the region has visits."""
    from rangeloom.operators import regions

    dealt = []
    monkeypatch.setattr(regions, "region_runs", lambda held, runs=regions.region_runs: dealt.append(held.count()) or runs(held))
    visits = spark.range(40).select(F.lit(1).alias("path_id"), F.col("id").alias("ord"), (F.col("id") * 2).alias("handle"), F.col("id").alias("node_id"))
    tiles = spark.range(40).select(F.explode(F.sequence(F.greatest(F.col("id") - 9, F.lit(0)), F.col("id"))).alias("tile_id"), F.col("id").alias("node_id"))
    pieces = regions.tile_pieces(tiles, visits)
    chosen = spark.range(5, 35).where("id <> 20").select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node_id"))
    got = regions.stitched_runs(pieces, tiles.select(F.lit(7).cast("long").alias("key"), "tile_id").distinct(), chosen).collect()
    assert sorted((r.key, r.path_id, r.first_ord, len(r.walk)) for r in got) == [(7, 1, 5, 15), (7, 1, 21, 14)]
    assert dealt[-1] == 29
