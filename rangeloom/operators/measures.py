"""Measurement analytics: distributions under two rank rules, frontiers, rounds, costs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize
from .ordered import running_count, running_reach, same_keys


#: Distinct values that a window may sort for a group, and bins of a pass that narrows larger groups.
SORTED_VALUES, BINS = 4096, 1024


def _picked(rows: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """For each key the values at 0-based positions of the sorted values; a position is an expression of `n`.

    Radix selection: values are counted first, then each pass cuts what lies between a position's bounds into `BINS` bins,
    counts them (which combines before the shuffle, so a hot group is the work of all tasks), and keeps the bin that the
    position falls into, with its own least and greatest value as bounds. Once no more than `SORTED_VALUES` different
    values are left between the bounds, they are sorted. Bounds are values that occur, so every pass narrows.
    """
    counted = materialize(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "counted-values")
    whole = counted.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    whole = materialize(whole, "value-groups")
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("_pick"), p.cast("long").alias("_at")) for name, p in picks.items()]))
    bounds = whole.select(*keys, at.alias("_p"), F.col("min").alias("_low"), F.col("max").alias("_high"), F.col("_d").alias("_d")).select(*keys, "_p._pick", "_p._at", "_low", "_high", "_d")
    bounds = materialize(bounds, "value-bounds")
    ready = []
    while True:
        ready.append(bounds.where(F.col("_d") <= SORTED_VALUES))
        wide = bounds.where(F.col("_d") > SORTED_VALUES)
        if not wide.limit(1).count():
            break
        width = (F.col("_high") - F.col("_low")).cast("double")
        bin_of = F.least(F.floor((F.col("_v") - F.col("_low")).cast("double") / width * BINS), F.lit(BINS - 1))
        inside = same_keys(counted, wide, keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        bins = inside.groupBy(*keys, "_pick", "_at", bin_of.alias("_bin")).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "_pick").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most BINS rows
        held = bins.withColumn("_upto", upto).where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at")))
        bounds = materialize(held.select(*keys, "_pick", (F.col("_at") - F.col("_upto") + F.col("_n")).alias("_at"), "_low", "_high", "_d"), "value-bounds")
    narrow = ready[0]
    for r in ready[1:]:
        narrow = narrow.unionByName(r)
    inside = same_keys(counted, narrow, keys).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_pick").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most SORTED_VALUES rows
    found = inside.withColumn("_upto", upto).where((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_c") <= F.col("_at")))
    here = [F.max(F.when(F.col("_pick") == name, F.col("_v"))).alias(name) for name in picks]
    found = found.groupBy(*keys).agg(*here)
    return same_keys(whole.select(*keys, "n", "max", "min"), found, keys).select(*keys, "n", *picks, "max", "min")


def distribution_ceil(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """Position ceil((n - 1) * p) of the sorted values."""
    return _picked(rows, keys, value, {f"p{p}": F.floor(((F.col("n") - 1) * p + 99) / 100) for p in shares})


def distribution_nearest_rank(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """Position ceil(n * p) - 1 of the sorted values."""
    return _picked(rows, keys, value, {f"p{p}": F.floor((F.col("n") * p + 99) / 100) - 1 for p in shares})


def grouped_with_all(rows: DataFrame, config: str, kind: str, value: str) -> DataFrame:
    """Count and extremes by (config, kind), and by config alone under the kind 'all'."""
    return (
        rows.groupingSets([(config, kind), (config,)], config, kind)
        .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.grouping(kind).alias("_all"))
        .withColumn(kind, F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(kind)))
        .drop("_all")
    )


def _undominated(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether no row of `others` dominates a row of x. others rise by their sum, so those that dominate stand first."""
    alive = np.ones(len(x), bool)
    for at in range(0, len(others), 64):
        some, rows = others[at : at + 64], np.flatnonzero(alive)
        if not len(rows):
            break
        for first in range(0, len(rows), 4096):
            part = rows[first : first + 4096]
            no_larger = (some[None, :, :] <= x[part][:, None, :]).all(axis=2)
            smaller = (some[None, :, :] < x[part][:, None, :]).any(axis=2)
            alive[part[(no_larger & smaller).any(axis=1)]] = False
    return alive


def _own_frontier(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x.sum(axis=1), kind="stable")
    held = np.zeros((0, x.shape[1]))
    kept = []
    for at in range(0, len(order), 1024):
        part = order[at : at + 1024]
        part = part[_undominated(x[part], held)]
        part = part[_undominated(x[part], x[part])]
        kept.append(part)
        held = np.concatenate([held, x[part]])
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)


def pareto_frontier(rows: DataFrame, key: str, metrics: Sequence[str], *, cells: int = 8) -> DataFrame:
    """Rows that no other row dominates (at most as large in all metrics and smaller in one).

    First every batch of a partition keeps its own frontier. What is left is filed in a grid of `cells` stretches of each
    metric, cut at approximate quantiles. A cell behind a held one in all metrics is dominated whole and goes; a row of any
    other cell can only be dominated by rows of cells that lie before it or beside it, which share a stretch with it, so
    only those are sent there, and each cell is a task. Metrics that rise as others fall fill a diagonal of cells, which
    see few others. Null metrics take no part.
    """
    names, columns = list(metrics), rows.columns
    rows = rows.where(F.greatest(*[F.col(m).isNull().cast("int") for m in names], F.lit(0)) == 0)

    def local(batches):
        for pdf in batches:
            yield pdf.iloc[_own_frontier(pdf[names].to_numpy(float))]

    left = materialize(rows.mapInPandas(local, rows.schema), "local-frontiers")
    cuts = left.stat.approxQuantile(names, [i / cells for i in range(1, cells)], 0.01)
    place = [sum((F.when(F.col(m) > c, 1).otherwise(0) for c in sorted(set(of))), F.lit(0)) for m, of in zip(names, cuts, strict=True)]
    left = left.withColumn("_cell", F.array(*place))
    held = [tuple(r[0]) for r in left.select("_cell").distinct().collect()]  # at most cells ^ metrics rows
    alive = [c for c in held if not any(all(a < b for a, b in zip(o, c, strict=True)) for o in held)]
    sent = [(list(o), list(c)) for c in alive for o in alive if all(a <= b for a, b in zip(o, c, strict=True))]
    if not sent:
        return rows.limit(0)
    to = left.sparkSession.createDataFrame(sent, "_cell array<int>, _to array<int>")
    own = left.join(F.broadcast(to.select("_cell").distinct()), "_cell")
    others = left.join(F.broadcast(to), "_cell").select(F.col("_to").alias("_cell"), *[F.col(m).cast("double").alias(m) for m in names])
    schema = T.StructType(list(rows.schema.fields))

    def merged(mine: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        x, y = mine[names].to_numpy(float), seen[names].to_numpy(float)
        return mine.loc[_undominated(x, y[np.argsort(y.sum(axis=1), kind="stable")]), columns]

    return own.groupBy("_cell").cogroup(others.groupBy("_cell")).applyInPandas(merged, schema)


def request_rounds(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `round`: a request opens a new round when it starts at or after the end of all earlier ones."""
    reached = running_reach(requests, keys, "start", "end")
    opens = F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), 1).otherwise(0)
    return running_count(reached, keys, ["start", "end"], opens).withColumnRenamed("_count", "round").drop("_block", "_reach")


#: Round-trip ms, overhead ms, megabits a second, parallel requests of the network profiles.
PROFILES = {"local": (1, 0, 1000, 8), "broadband": (20, 5, 100, 6), "mobile": (80, 10, 20, 6), "slow": (150, 20, 5, 4)}


def network_cost(requests: Column, size: Column, rounds: Column, profile: str) -> Column:
    """Milliseconds: the rounds that dependencies or parallelism force, and the transfer."""
    rtt, overhead, mbps, parallel = PROFILES[profile]
    trips = F.greatest(rounds, F.ceil(requests / parallel))
    return (trips * (rtt + overhead)).cast("double") + size * 8 / (mbps * 1000)


def ratio(a: Column, b: Column) -> Column:
    """a / b, infinite over zero."""
    return F.when(b == 0, F.lit(float("inf"))).otherwise(a.cast("double") / b)


def argmin(rows: DataFrame, keys: Sequence[str], choice: str, cost: str) -> DataFrame:
    """Per key the choice of least cost, then of least name."""
    return rows.groupBy(*keys).agg(F.min(F.struct(F.col(cost), F.col(choice))).alias("_b")).select(*keys, F.col(f"_b.{choice}").alias(choice), F.col(f"_b.{cost}").alias(cost))


def id_runs(ids: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: ids, runs of consecutive ids, and the bytes of two encodings (8 a run start and length; 1 to 9 a delta)."""
    by = Window.partitionBy(*keys).orderBy(value)
    step = ids.select(*keys, value).distinct().withColumn("_d", F.col(value) - F.lag(value).over(by))
    delta = F.coalesce(F.col("_d"), F.col(value))
    width = F.greatest(F.lit(1), F.ceil(F.length(F.bin(delta)) / 7))
    out = step.groupBy(*keys).agg(F.count(F.lit(1)).alias("ids"), F.sum(F.when(F.coalesce(F.col("_d"), F.lit(0)) == 1, 0).otherwise(1)).alias("runs"), F.sum(width).alias("delta_bytes"))
    out = out.withColumn("run_bytes", F.col("runs") * 16)
    return out.withColumn("codec", F.when(F.col("run_bytes") < F.col("delta_bytes"), "runs").otherwise("delta"))
