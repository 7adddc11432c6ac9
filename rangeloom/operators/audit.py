"""Comparisons that must come out even: pairings, reconciliations, audits, expected against actual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_blocks, running_count

def pairing(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer pairing of two tables on keys, with `status`: same, differs, missing (only in a) or extra (only in b)."""
    left = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("_b"))
    equal = F.lit(True)
    for v in values:
        equal = equal & F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(equal, "same").otherwise("differs")
    return left.join(right, list(keys), "full_outer").withColumn("status", status).drop("_a", "_b")


def name_audit(expected: DataFrame, seen: DataFrame, name: str) -> DataFrame:
    """Names with `status`: missing, extra, duplicate or found. seen may repeat names."""
    counts = seen.groupBy(name).agg(F.count(F.lit(1)).alias("seen"))
    wanted = expected.select(name).distinct().withColumn("_wanted", F.lit(True))
    held = wanted.join(counts, name, "full_outer").withColumn("seen", F.coalesce("seen", F.lit(0)))
    status = F.when(F.col("_wanted").isNull(), "extra").when(F.col("seen") == 0, "missing").when(F.col("seen") > 1, "duplicate").otherwise("found")
    return held.withColumn("status", status).drop("_wanted")


def outcome(expected_hash: Column, expected_error: Column, actual_hash: Column, actual_error: Column) -> Column:
    """Verdict on a query of a workload: exactly one of hash and error is expected, an error by part of its text."""
    alias = F.when(expected_error == "reference-not-found", F.lit("not found")).otherwise(expected_error)
    return (
        F.when(expected_hash.isNotNull() == expected_error.isNotNull(), "invalid workload")
        .when(expected_hash.isNotNull(), F.when(actual_hash.eqNullSafe(expected_hash), "passed").otherwise("failed"))
        .otherwise(F.when(F.coalesce(F.contains(actual_error, alias), F.lit(False)), "passed").otherwise("failed"))
    )


def occurrences(visits: DataFrame) -> DataFrame:
    """Adds `occurrence`: numbers the visits of each (tile_id, handle) from 0, by path and place, over blocks of path ids."""
    counted = running_count(in_blocks(visits, "path_id"), ["tile_id", "handle"], ["path_id", "ord"], F.lit(1))
    return counted.withColumn("occurrence", F.col("_count") - 1).drop("_block", "_count")


def locate(starts: DataFrame, visits: DataFrame) -> DataFrame:
    """The path of each (tile, handle, occurrence): occurrences of a handle are numbered by path and place.

    With the walks stored, locating is one equi-join; starts without a path are an error.
    """
    numbered = occurrences(visits).select("tile_id", "handle", "occurrence", "path_id", F.lit(True).alias("_found"))
    held = starts.join(numbered, ["tile_id", "handle", "occurrence"], "left")
    found = F.when(F.col("_found"), True).otherwise(F.raise_error(F.lit("an occurrence belongs to no path")).cast("boolean"))
    return held.where(found).drop("_found")


def successor_runs(visits: DataFrame) -> DataFrame:
    """Run-length coding of each handle's successors in the order of paths: tile_id, handle, run, successor (0 at an end), length.

    A run starts where the occurrence before has another successor, which an equi-join on its number tells.
    """
    step = Window.partitionBy("tile_id", "path_id").orderBy("ord")
    next_ = occurrences(visits.withColumn("successor", F.coalesce(F.lead("handle").over(step), F.lit(0))))
    before = next_.select("tile_id", "handle", (F.col("occurrence") + 1).alias("occurrence"), F.col("successor").alias("_before"))
    marked = next_.join(before, ["tile_id", "handle", "occurrence"], "left")
    new = F.when(F.col("_before").eqNullSafe(F.col("successor")), 0).otherwise(1)
    runs = running_count(in_blocks(marked, "path_id"), ["tile_id", "handle"], ["path_id", "ord"], new).withColumnRenamed("_count", "run")
    return runs.groupBy("tile_id", "handle", "run", "successor").agg(F.count(F.lit(1)).alias("length"))


def expanded_runs(runs: DataFrame) -> DataFrame:
    """The inverse of successor_runs: a row for each occurrence."""
    by = Window.partitionBy("tile_id", "handle").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    start = runs.withColumn("_from", F.coalesce(F.sum("length").over(by), F.lit(0)))
    return start.select("tile_id", "handle", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("length") - 1)).alias("occurrence"), "successor")


def grouped_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between groups of nodes: ends mapped, loops dropped, one edge for each pair (the smallest).

    edges: from_handle, to_handle; groups: node_id, group.
    """
    ends = edges.withColumn("_f", F.shiftright("from_handle", 1)).withColumn("_t", F.shiftright("to_handle", 1))
    mapped = ends.join(groups.select(F.col("node_id").alias("_f"), F.col("group").alias("from_group")), "_f").join(groups.select(F.col("node_id").alias("_t"), F.col("group").alias("to_group")), "_t")
    kept = mapped.where(F.col("from_group") != F.col("to_group"))
    return kept.groupBy("from_group", "to_group").agg(F.min(F.struct("from_handle", "to_handle")).alias("_e"), F.count(F.lit(1)).alias("edges")).select("from_group", "to_group", F.col("_e.from_handle").alias("from_handle"), F.col("_e.to_handle").alias("to_handle"), "edges")
