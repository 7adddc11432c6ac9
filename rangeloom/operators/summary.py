"""Multiscale summaries of tiles: base bins, pyramids, level choice, clipped queries, prorated estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Above any genome: 4^20 base bins.
MOST_LEVELS = 20
COUNTERS = ("covered_bases", "tile_count", "encoded_bytes", "decoded_bytes", "node_records")


def base_bins(tiles: DataFrame, span: int) -> DataFrame:
    """Sums of the tiles of each bin; a tile that crosses a bin's end is an error. tiles: manifest_id, core_start, core_end and COUNTERS."""
    start = F.floor(F.col("core_start") / span) * span
    inside = F.when(F.col("core_end") <= start + span, start).otherwise(F.raise_error(F.lit("a tile crosses a summary bin")).cast("long"))
    return tiles.groupBy("manifest_id", inside.alias("bin_start")).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def pyramid(base: DataFrame, span: int, factor: int = 4) -> DataFrame:
    """All levels up to the first at which the manifest has one bin: manifest_id, level, bin_span, bin_start, COUNTERS.

    The parent grid starts at 0. A base bin is copied to its ancestors and summed there, in one shuffle: it has
    as many ancestors as levels, the logarithm of the manifest's length.
    """
    ends = base.groupBy("manifest_id").agg(F.min("bin_start").alias("lo"), F.max("bin_start").alias("hi"))
    levels = F.sequence(F.lit(0), F.lit(MOST_LEVELS))
    width = lambda x: F.lit(span) * F.pow(F.lit(factor), x).cast("long")
    single = F.filter(levels, lambda x: F.floor(F.col("lo") / width(x)) == F.floor(F.col("hi") / width(x)))
    tops = ends.select("manifest_id", F.element_at(single, 1).alias("top"))
    spread = base.join(tops, "manifest_id").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
    spread = spread.withColumn("bin_span", width(F.col("level"))).withColumn("bin_start", F.floor(F.col("bin_start") / F.col("bin_span")) * F.col("bin_span"))
    return spread.groupBy("manifest_id", "level", "bin_span", "bin_start").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def levels_within(series: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Level of each manifest of a view: keys, manifest_id, level. series: keys, manifest_id, level (from 0 on), bins.

    While a view's bins exceed `most`, the manifest whose next level saves most is coarsened, the
    first of equals. A step is taken once it is the best one open, so steps come in order of the least saving up to
    them; a step that saves nothing bars all that follow. A running sum then tells how many steps a view takes.
    """
    by = Window.partitionBy(*keys, "manifest_id").orderBy("level")
    steps = series.withColumn("_saves", F.col("bins") - F.lead("bins").over(by)).where(F.col("_saves").isNotNull())
    steps = steps.withColumn("_least", F.min("_saves").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("_least") > 0)
    finest = series.where(F.col("level") == 0)
    totals = finest.groupBy(*keys).agg(F.sum("bins").alias("_total"))
    before = Window.partitionBy(*keys).orderBy(F.desc("_least"), "manifest_id", "level").rowsBetween(Window.unboundedPreceding, -1)
    taken = steps.join(totals, keys).withColumn("_left", F.col("_total") - F.coalesce(F.sum("_saves").over(before), F.lit(0))).where(F.col("_left") > most)
    counts = taken.groupBy(*keys, "manifest_id").agg((F.max("level") + 1).alias("_level"))
    return finest.join(counts, [*keys, "manifest_id"], "left").select(*keys, "manifest_id", F.coalesce("_level", F.lit(0)).cast("int").alias("level"))


def query_bins(bins: DataFrame, selected: DataFrame) -> DataFrame:
    """Bins under each query, clipped, with the fraction covered. selected: query_id, manifest_id, q_start, q_end, level."""
    spans = bins.select("manifest_id", "level", "bin_span").distinct()
    first, last = F.floor(F.col("q_start") / F.col("bin_span")), F.floor((F.col("q_end") - 1) / F.col("bin_span"))
    asked = selected.join(spans, ["manifest_id", "level"]).withColumn("bin_start", F.explode(F.sequence(first, last))).withColumn("bin_start", F.col("bin_start") * F.col("bin_span"))
    hit = bins.join(asked, ["manifest_id", "level", "bin_span", "bin_start"])
    start, end = F.greatest("bin_start", "q_start"), F.least(F.col("bin_start") + F.col("bin_span"), F.col("q_end"))
    return hit.withColumn("clip_start", start).withColumn("clip_end", end).withColumn("coverage_fraction", (F.col("clip_end") - F.col("clip_start")).cast("double") / F.col("bin_span"))


def prorated(value: Column, covered: Column, full: Column) -> Column:
    """The share of a counter, rounded up in whole numbers."""
    return F.floor((value * covered + full - 1) / full)


def estimate(clipped: DataFrame) -> DataFrame:
    """Per query: what a detailed answer would read, from query_bins."""
    covered, full = F.col("clip_end") - F.col("clip_start"), F.col("bin_span")
    return clipped.groupBy("query_id").agg(F.count(F.lit(1)).alias("bins"), *[F.sum(prorated(F.col(c), covered, full)).alias(c) for c in COUNTERS])


def dense_bins(base: DataFrame, span: int) -> DataFrame:
    """base with a row of zeros for every empty bin between a manifest's first and last."""
    ends = base.groupBy("manifest_id").agg(F.min("bin_start").alias("lo"), F.max("bin_start").alias("hi"))
    grid = ends.select("manifest_id", F.explode(F.sequence("lo", "hi", F.lit(span))).alias("bin_start"))
    return grid.join(base, ["manifest_id", "bin_start"], "left").select("manifest_id", "bin_start", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS])


def level_counts(levels: DataFrame) -> DataFrame:
    return levels.groupBy("manifest_id").agg((F.max("level") + 1).cast("long").alias("levels"))


def bin_contiguity_violations(levels: DataFrame) -> DataFrame:
    """Bins that do not follow their predecessor on the grid of their level."""
    by = Window.partitionBy("manifest_id", "level").orderBy("bin_start")
    return levels.withColumn("_gap", F.col("bin_start") - F.lag("bin_start").over(by)).where(F.col("_gap").isNotNull() & (F.col("_gap") != F.col("bin_span"))).drop("_gap")
