"""Ordered scans that do not put a whole key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(rows: DataFrame, keys: Sequence[str], order: str, value: Column, *, block: int = 1 << 16) -> DataFrame:
    """Adds `before`: the sum of value over the rows of the same keys with a smaller `order` (a whole number, unique in its key).

    Rows are summed within blocks of `block` consecutive order values; the totals of the blocks, a row each,
    give every block its start. A key of any length is thus spread over its blocks.
    """
    cut = rows.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cut.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    summed = cut.withColumn("_within", F.sum("_value").over(inside) - F.col("_value"))
    return summed.join(starts, [*keys, "_block"]).withColumn("before", F.col("_start") + F.col("_within")).drop("_block", "_value", "_start", "_within")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys, of which nulls are equal; right's keys go."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(right, cond, how).drop(*[f"_right_{k}" for k in keys])


def in_blocks(rows: DataFrame, start: str, blocks: int = 1024) -> DataFrame:
    """Adds `_block`: rows cut into `blocks` equal stretches of the whole range of `start`, whose ends alone reach the driver."""
    low, high = rows.agg(F.min(start), F.max(start)).head()
    if low is None:
        return rows.withColumn("_block", F.lit(0).cast("long"))
    width = max(1, -(-(int(high) - int(low) + 1) // blocks))
    return rows.withColumn("_block", F.floor((F.col(start) - int(low)) / width))


def running_reach(rows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Adds `_block` and `_reach`: the largest `end` among earlier rows of the same keys, in order of (start, end); null for the first.

    Rows are ordered within blocks of the range only; a row for each block carries the reach of the blocks before it.
    """
    cut = in_blocks(rows, start)
    tops = cut.groupBy(*keys, "_block").agg(F.max(end).alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("_carried", F.max("_top").over(before)).drop("_top")
    inside = Window.partitionBy(*keys, "_block").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return same_keys(cut, carried, [*keys, "_block"]).withColumn("_reach", F.greatest("_carried", F.max(end).over(inside))).drop("_carried")


def running_count(rows: DataFrame, keys: Sequence[str], order: Sequence[str], counted: Column) -> DataFrame:
    """Adds `_count`: the sum of `counted` up to each row, over the blocks of `_block` as running_reach leaves them.

    Rows that tie in `order` get one sum, which takes in all of them: which of them came first in an earlier scan
    is not told again by this one.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.withColumn("_counted", counted)
    totals = held.groupBy(*keys, "_block").agg(F.sum("_counted").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    return same_keys(held, starts, [*keys, "_block"]).withColumn("_count", F.col("_start") + F.sum("_counted").over(inside)).drop("_counted", "_start")


def neighbour(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, *, after: bool = False) -> DataFrame:
    """Adds `name`: the value of the row before (or after) in the same keys, in order; null at the end. Over the blocks of `_block`.

    A row looks within its block; the first (or last) row of a block takes what the nearest block before (or after) it
    ends (or begins) with, which a row a block carries on.
    """
    sort = [F.col(c).desc() if after else F.col(c).asc() for c in order]
    inside = Window.partitionBy(*keys, "_block").orderBy(*sort)
    edge = F.struct(*[F.col(c) for c in order], F.col(value).alias("_v"))
    ends = rows.groupBy(*keys, "_block").agg((F.min(edge) if after else F.max(edge)).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy(F.col("_block").desc() if after else F.col("_block").asc())
    ends = ends.withColumn("_beyond", F.lag("_edge").over(across)["_v"]).drop("_edge")
    held = rows.withColumn("_first", F.row_number().over(inside) == 1).withColumn(name, F.lag(value).over(inside))
    return same_keys(held, ends, [*keys, "_block"]).withColumn(name, F.when(F.col("_first"), F.col("_beyond")).otherwise(F.col(name))).drop("_first", "_beyond")


def islands(rows: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Adds `island`: numbers runs of intervals in which each starts at most `gap` after all earlier ones end."""
    reached = running_reach(rows, keys, start, end)
    opens = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), 1).otherwise(0)
    return running_count(reached, keys, [start, end], opens).withColumnRenamed("_count", "island").drop("_block", "_reach")


def coalesced(rows: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """The union of the intervals of each key: (keys, start, end, members)."""
    return islands(rows, keys, start, end, gap).groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("members")).drop("island")
