"""Display models as tables: ranked patterns, lanes, budgets, first-seen order, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.handles import walk_key


def ranked_patterns(weighted: DataFrame, most: int) -> DataFrame:
    """The `most` heaviest walks of each tile: adds local_rank by weight, then walk."""
    by = Window.partitionBy("tile_id").orderBy(F.col("weight").desc(), "walk")
    return weighted.withColumn("local_rank", F.row_number().over(by)).where(F.col("local_rank") <= most)


def top_patterns(weighted: DataFrame, most: int) -> DataFrame:
    """The `most` walks overall, by local rank, weight, tile and walk; a top-k, not a global sort."""
    ranked = ranked_patterns(weighted, most)
    return ranked.orderBy("local_rank", F.col("weight").desc(), "tile_id", "walk").limit(most)


def retained_lanes(weighted: DataFrame, most: int = 24) -> DataFrame:
    """Per tile the walks kept on screen: by weight, then length, then arrival (the walk's order)."""
    by = Window.partitionBy("tile_id").orderBy(F.col("weight").desc(), F.size("walk"), "walk")
    return weighted.withColumn("lane", F.row_number().over(by)).where(F.col("lane") <= most)


def first_seen(visits: DataFrame) -> DataFrame:
    """The first tile and place at which each node occurs: a minimum by struct, which combines before the shuffle."""
    return visits.groupBy("node_id").agg(F.min(F.struct("tile_id", "ord")).alias("_f")).select("node_id", F.col("_f.tile_id").alias("tile_id"), F.col("_f.ord").alias("ord"))


def node_budget(nodes: DataFrame, most: int) -> DataFrame:
    """Per key at most `most` nodes, reference nodes first, in order of id; adds kept and the number left out."""
    by = Window.partitionBy("key").orderBy(~F.col("is_reference"), "node_id")
    ranked = nodes.withColumn("place", F.row_number().over(by)).withColumn("kept", F.col("place") <= most)
    return ranked.withColumn("omitted", F.greatest(F.lit(0), F.count(F.lit(1)).over(Window.partitionBy("key")) - most))


def thickness(weight: Column) -> Column:
    """1 + the bits of the weight, between 2 and 9."""
    return F.least(F.lit(9), F.greatest(F.lit(2), 1 + F.length(F.bin(weight))))


def recommended_bins(pixels: Column) -> Column:
    return F.least(F.lit(1024), F.greatest(F.lit(32), F.ceil(pixels / 4)))


def exceeded_limits(span: Column, size: Column, payloads: Column) -> Column:
    """Which limits of a detailed view a region exceeds."""
    return F.filter(
        F.array(F.when(span > 100_000, F.lit("span")), F.when(size > 4 * 1024 * 1024, F.lit("bytes")), F.when(payloads > 8, F.lit("payloads"))), lambda x: x.isNotNull()
    )


def centred_region(centre: Column, span: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """An interval of `span` around a centre, shifted into the reference and clipped to it."""
    width = F.least(span, end - start)
    left = F.greatest(start, F.least(centre - F.floor(width / 2), end - width))
    return left, left + width


def adjacent_distinct(visits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Visits without those whose value equals the one before."""
    by = Window.partitionBy(*keys).orderBy("ord")
    return visits.withColumn("_p", F.lag(value).over(by)).where(~F.col("_p").eqNullSafe(F.col(value))).drop("_p")


def path_table(walks: DataFrame) -> DataFrame:
    """Tab-separated lines of walks with their path names: path_id, line."""
    from ..functions.text import one_line

    return walks.select("path_id", F.concat_ws("\t", one_line(F.col("canonical_name")), one_line(F.col("sample")), one_line(F.col("contig")), F.col("haplotype").cast("string"), F.col("fragment").cast("string"), walk_key(F.col("walk"))).alias("line"))
