"""Walks of paths through tiles: successors, local pieces, distinct weighted walks, memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import handles as H


def successors(visits: DataFrame) -> DataFrame:
    """Adds to each visit the handle and order of the next one on its path in its tile (null at the end)."""
    by = Window.partitionBy("tile_id", "path_id").orderBy("ord")
    return visits.withColumn("next_handle", F.lead("handle").over(by)).withColumn("next_ord", F.lead("ord").over(by))


def traversal_starts(visits: DataFrame) -> DataFrame:
    """Visits that are nobody's successor within their tile: an anti-join on (tile, path, ord)."""
    steps = successors(visits)
    reached = steps.where(F.col("next_ord").isNotNull()).select("tile_id", "path_id", F.col("next_ord").alias("ord"))
    return visits.join(reached, ["tile_id", "path_id", "ord"], "left_anti")


def local_walks(walks: DataFrame, local: DataFrame) -> DataFrame:
    """Maximal runs of consecutive visits whose node belongs to the tile.

    walks: path_id, ord (consecutive), handle, node_id; local: tile_id, node_id. Returns tile_id, path_id, piece, walk.
    A run within (tile, path) has a constant ord - row_number, so no list of foreign visits is built.
    """
    held = walks.join(local, "node_id")
    by = Window.partitionBy("tile_id", "path_id").orderBy("ord")
    runs = held.withColumn("piece", F.col("ord") - F.row_number().over(by))
    packed = runs.groupBy("tile_id", "path_id", "piece").agg(F.array_sort(F.collect_list(F.struct("ord", "handle"))).alias("steps"))
    return packed.select("tile_id", "path_id", "piece", F.transform("steps", lambda s: s["handle"]).alias("walk"))


def both_strands(walks: DataFrame) -> DataFrame:
    """Each walk and its mirror image; `reversed` tells the latter."""
    strands = F.array(F.struct(F.lit(False).alias("reversed"), F.col("walk").alias("walk")), F.struct(F.lit(True).alias("reversed"), H.mirrored(F.col("walk")).alias("walk")))
    return walks.withColumn("_s", F.explode(strands)).withColumn("reversed", F.col("_s.reversed")).withColumn("walk", F.col("_s.walk")).drop("_s")


def weighted_walks(walks: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Distinct canonical walks per tile with their multiplicity: tile_id, walk, weight.

    Both strands are generated and the canonical ones kept; a walk canonical on both counts twice. The tile's
    reference walk, if given as (tile_id, walk), is subtracted once, and walks of weight zero vanish.
    """
    kept = both_strands(walks).where(H.is_canonical_walk(F.col("walk")))
    counted = kept.groupBy("tile_id", "walk").agg(F.count(F.lit(1)).alias("weight"))
    if reference is None:
        return counted
    taken = reference.select("tile_id", "walk").distinct().withColumn("_taken", F.lit(1))
    left = counted.join(taken, ["tile_id", "walk"], "left").withColumn("weight", F.col("weight") - F.coalesce("_taken", F.lit(0))).drop("_taken")
    return left.where(F.col("weight") > 0)


def multiset_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Walks whose weights differ between two multisets: tile_id, walk, weight_a, weight_b (0 where missing)."""
    a, b = a.withColumnRenamed("weight", "weight_a"), b.withColumnRenamed("weight", "weight_b")
    both = a.join(b, ["tile_id", "walk"], "full_outer").select("tile_id", "walk", F.coalesce("weight_a", F.lit(0)).alias("weight_a"), F.coalesce("weight_b", F.lit(0)).alias("weight_b"))
    return both.where(F.col("weight_a") != F.col("weight_b"))


def memberships(walks: DataFrame) -> DataFrame:
    """Who makes up each canonical walk: tile_id, walk, path_id, reversed, multiplicity."""
    kept = both_strands(walks).where(H.is_canonical_walk(F.col("walk")))
    return kept.groupBy("tile_id", "walk", "path_id", "reversed").agg(F.count(F.lit(1)).alias("multiplicity"))


def membership_groups(members: DataFrame) -> DataFrame:
    """Per canonical walk: occurrence_weight and unique_path_count, in two levels to spare a distinct over all rows."""
    by_path = members.groupBy("tile_id", "walk", "path_id").agg(F.sum("multiplicity").alias("n"))
    return by_path.groupBy("tile_id", "walk").agg(F.sum("n").alias("occurrence_weight"), F.count(F.lit(1)).alias("unique_path_count"))


def unmatched_groups(groups: DataFrame, anonymous: DataFrame) -> DataFrame:
    """Named groups and anonymous walks that do not match one to one with equal weight; a sound archive has none."""
    both = groups.join(anonymous, ["tile_id", "walk"], "full_outer")
    return both.where(F.col("occurrence_weight").isNull() | F.col("weight").isNull() | (F.col("occurrence_weight") != F.col("weight")))


def referenced_paths(members: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows of the paths that members name; a path without a catalog row is an error."""
    wanted = members.select("path_id").distinct()
    held = wanted.join(catalog.withColumn("_known", F.lit(True)), "path_id", "left")
    known = F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit("path missing from the catalog: "), F.col("path_id").cast("string"))).cast("boolean"))
    return held.where(known).drop("_known")


def walk_digest(sample: Column, contig: Column, start: Column, end: Column, walk: Column) -> Column:
    """A SHA-256 that binds a walk to its reference interval."""
    return F.sha2(F.concat_ws("|", sample, contig, start.cast("string"), end.cast("string"), H.walk_key(walk)), 256)


def walk_sequences(walks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds `sequence`: node sequences joined along the walk, reverse-complemented where a visit is reversed.

    walks: walk_id, walk, and anything else; nodes: node_id, seq.
    """
    from ..functions.text import reverse_complement

    steps = walks.select("walk_id", F.posexplode("walk").alias("pos", "handle")).withColumn("node_id", H.node_of(F.col("handle")))
    read = steps.join(nodes.select("node_id", "seq"), "node_id").withColumn("part", F.when(H.is_reverse(F.col("handle")), reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    joined = read.groupBy("walk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda s: s["part"]), "").alias("sequence"))
    return walks.join(joined, "walk_id", "left").withColumn("sequence", F.coalesce("sequence", F.lit("")))


def tile_evidence(weighted: DataFrame) -> DataFrame:
    """Per tile: walks, their total weight, and visits counted by weight."""
    return weighted.groupBy("tile_id").agg(F.count(F.lit(1)).alias("walks"), F.sum("weight").alias("total_weight"), F.sum(F.size("walk") * F.col("weight")).alias("weighted_visits"))
