"""The logical tables of a sequence-graph archive, derived from the driver's tables.

Every derivation is a plan over the given Parquet tables, so it grows with them. Windows and limits are
constants, never row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW_BASES = 64
BUCKET_WINDOWS = 32
#: Milliseconds of the event tiles: six hours.
EVENT_TILE_MS = 6 * 3600 * 1000
#: Event types in order of their node number.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequence_of(key: Column, size: Column) -> Column:
    """An invented nucleotide sequence of 1 + size mod 17 bases from the digits of a key."""
    digits = F.translate(F.lpad(key.cast("string"), 9, "0"), "0123456789", "ACGTTGCAAC")
    return F.substring(F.repeat(digits, 2), F.lit(1), 1 + F.pmod(size, F.lit(17)))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, seq."""
    p = read(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") + 1).alias("node_id"), sequence_of(F.col("p_partkey"), F.col("p_size")).alias("seq"))


def reference_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, ord, handle, node_id, seq_len, path_start: one reference path for each brand, parts in order of key."""
    p = read(spark, sf_dir, "part")
    node = F.col("p_partkey") + 1
    return p.select(
        F.col("p_brand").alias("contig"), F.col("p_partkey").alias("ord"), (node * 2).alias("handle"), node.alias("node_id"),
        (1 + F.pmod(F.col("p_size"), F.lit(17))).cast("long").alias("seq_len"), (100 * F.length("p_brand") + F.lit(7)).cast("long").alias("path_start"),
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manifest_id, sample, contig, start, end, window_size, bucket_span. A row for each brand, so the window is over brands."""
    spans = reference_walk(spark, sf_dir).groupBy("contig").agg(F.min("path_start").alias("start"), (F.min("path_start") + F.sum("seq_len")).alias("end"))
    return spans.select(
        F.row_number().over(Window.orderBy("contig")).cast("long").alias("manifest_id"), F.lit("REF").alias("sample"), "contig", "start", "end",
        F.lit(WINDOW_BASES).cast("long").alias("window_size"), F.lit(WINDOW_BASES * BUCKET_WINDOWS).cast("long").alias("bucket_span"),
    )


def region_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, sample, contig, q_start, q_end: a region for each supplier, dealt over the brands and spread over the whole of each."""
    s, key = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    brand = F.concat(F.lit("Brand#"), (F.pmod(key, F.lit(25)) + 1).cast("string"))
    asked = s.select(key.alias("query_id"), F.lit("REF").alias("sample"), brand.alias("contig"))
    spans = manifests(spark, sf_dir).select("contig", "start", "end")  # a row a brand
    q = F.col("query_id")
    start = F.col("start") + F.pmod(q * 7919, F.col("end") - F.col("start"))
    return asked.join(F.broadcast(spans), "contig").select("query_id", "sample", "contig", start.alias("q_start"), (start + 1 + F.pmod(q * 13, F.lit(200))).alias("q_end"))


def placed_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reference_walk with `place`, gapless from 0 on each contig."""
    from ..operators.ordered import prefix_sums

    return prefix_sums(reference_walk(spark, sf_dir), ["contig"], "ord", F.lit(1)).withColumn("place", F.col("before").cast("long")).drop("before")


def haplotype_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, ord, handle, node_id: each order as a haplotype along one contig, a visit for each of its lines.

    It starts at the part of its first line and goes on by one to three places of that contig for each further line, so
    it skips nodes; a seventh of the visits, by quantity, are inverted. Edges thus join near places and every line counts.
    """
    line = read(spark, sf_dir, "lineitem")
    placed = placed_walk(spark, sf_dir)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    step = F.when(F.row_number().over(order) == 1, 0).otherwise(1 + F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(3)))
    lines = line.withColumn("ord", F.row_number().over(order).cast("long")).withColumn("step", step).withColumn("anchor", F.first("l_partkey").over(order))
    moved = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = lines.select(F.col("l_orderkey").alias("path_id"), "ord", "anchor", (F.col("l_quantity").cast("long") % 7 == 0).alias("turned"), moved.alias("moved"))
    lengths = placed.groupBy("contig").agg(F.count(F.lit(1)).alias("length"))  # a row a brand
    before = Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.withColumn("base", F.coalesce(F.sum("length").over(before), F.lit(0)))
    # Places of all contigs are numbered on, so lines go from shuffle to shuffle without the contig's name.
    spots = placed.join(F.broadcast(lengths), "contig").select("ord", "node_id", "place", "base", "length")
    anchors = spots.select(F.col("ord").alias("anchor"), F.col("place").alias("from"), "base", "length")
    held = lines.join(anchors.hint("shuffle_hash"), "anchor").withColumn("spot", F.col("base") + (F.col("from") + F.col("moved")) % F.col("length"))
    held = held.select("path_id", "ord", "turned", "spot").join(spots.select((F.col("base") + F.col("place")).alias("spot"), "node_id").hint("shuffle_hash"), "spot")
    return held.select("path_id", "ord", (F.col("node_id") * 2 + F.when(F.col("turned"), 1).otherwise(0)).alias("handle"), "node_id")


def order_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, ord, handle, node_id: the parts of each order, reversed where the line's status is F."""
    line = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    node = F.col("l_partkey") + 1
    return line.select(F.col("l_orderkey").alias("path_id"), F.row_number().over(order).cast("long").alias("ord"), (node * 2 + F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("handle"), node.alias("node_id"))


def event_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, path_id, ord, handle: each user's events in tiles of six hours; the node is the event type."""
    e = read(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type"))
    tile = F.floor(ms / EVENT_TILE_MS)
    order = Window.partitionBy("user_id", tile).orderBy("ts", "event_id")
    return e.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(
        tile.alias("tile_id"), F.col("user_id").alias("path_id"), F.row_number().over(order).cast("long").alias("ord"), (kind * 2 + F.pmod(F.col("event_id"), F.lit(2))).cast("long").alias("handle")
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, canonical_name, sample, contig, haplotype, fragment: one path for each order."""
    from ..functions.text import path_name

    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    held = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    haplotype = F.substring("o_orderpriority", 1, 1).cast("long")
    fragment = F.pmod(F.col("o_custkey"), F.lit(7)).cast("long")
    return held.select(F.col("o_orderkey").alias("path_id"), path_name(F.col("n_name"), haplotype, F.col("c_mktsegment"), fragment).alias("canonical_name"), F.col("n_name").alias("sample"), F.col("c_mktsegment").alias("contig"), haplotype.alias("haplotype"), fragment.alias("fragment"))


def stored_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, start, end: byte ranges read, one for each order line, keyed by supplier."""
    line = read(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") * 64
    return line.select(F.col("l_suppkey").alias("key"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 8).alias("end"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """config, class, latency: one for each order."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("config"), F.col("o_orderpriority").alias("class"), F.col("o_totalprice").alias("latency"), F.col("o_orderkey").alias("id"))
