"""The state of a view that tiles are added to: bounded by a budget for each kind of item, the same in whatever order they come.

A view keeps the best items of each kind by (priority, item), smaller first, with how often each was seen and the sum of
its weights. A priority belongs to the item, so what has been put out never comes back: once as many better items are
known as the budget has places, no later tile makes room again. Hence what a kept item has summed is complete, and
a snapshot depends neither on the order of the tiles nor on how they were cut into micro-batches.

A view's items are dealt to shards by their hash, each with the whole budget, so a view that holds a third of all rows is
the work of many tasks; the snapshot takes the best of the shards' best. Tasks fold their own rows before the shuffle.

Cases: rows with a null view, kind, item or priority take no part, a null weight is 0; kinds without a budget show nothing;
an item that comes with two priorities is two items; no rows give no snapshot. Other columns are left aside.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .tiles import run_upserts

STATE = "items array<string>, priorities array<long>, seen array<long>, weights array<long>, decoded long"
HELD = f"view string, kind string, shard int, {STATE}"
_ROW = "view string, kind string, shard int, item string, priority long, seen long, weight long, decoded long"


def fold(batch: pd.DataFrame, budgets: dict[str, int]) -> pd.DataFrame:
    """The rows of a batch summed by item, at most a budget of them for each view, kind and shard, the first of which carries how many rows there were."""
    keys = ["view", "kind", "shard"]
    summed = batch.groupby([*keys, "priority", "item"], as_index=False)[["seen", "weight"]].sum()
    summed = summed.sort_values([*keys, "priority", "item"], kind="stable")
    groups = summed.groupby(keys, sort=False)
    place = groups.cumcount()
    summed["decoded"] = groups["seen"].transform("sum").where(place == 0, 0)
    # The first row of a kind without places stays, as the bearer of its count.
    return summed[place < summed["kind"].map(lambda k: max(1, budgets.get(k, 0)))]


def bounded_views(rows: DataFrame, budgets: dict[str, int], *, shards: int = 16) -> DataFrame:
    """The state of every (view, kind, shard) that a micro-batch changes, as HELD. rows: a stream of view, kind, item, priority, weight."""

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fold(batch, budgets)[["view", "kind", "shard", "item", "priority", "seen", "weight", "decoded"]]

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        view, kind, shard = key
        places = budgets.get(kind, 0)
        items, priorities, seen, weights, decoded = state.get if state.exists else ([], [], [], [], 0)
        held = {(p, i): (s, w) for i, p, s, w in zip(items, priorities, seen, weights, strict=True)}
        for batch in batches:
            decoded += int(batch["decoded"].sum())
            for p, i, s, w in zip(*(batch[c].tolist() for c in ("priority", "item", "seen", "weight")), strict=True):
                before = held.get((p, i), (0, 0))
                held[p, i] = (before[0] + s, before[1] + w)
            held = {k: held[k] for k in heapq.nsmallest(places, held)}
        now = ([i for _, i in held], [p for p, _ in held], [s for s, _ in held.values()], [w for _, w in held.values()], decoded)
        state.update(now)
        yield pd.DataFrame([(view, kind, shard, *now)], columns=["view", "kind", "shard", "items", "priorities", "seen", "weights", "decoded"])

    whole = F.col("view").isNotNull() & F.col("kind").isNotNull() & F.col("item").isNotNull() & F.col("priority").isNotNull()
    dealt = rows.where(whole).select(
        F.col("view").cast("string").alias("view"), "kind", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"), F.col("item").cast("string").alias("item"),
        F.col("priority").cast("long").alias("priority"), F.lit(1).cast("long").alias("seen"), F.coalesce(F.col("weight").cast("long"), F.lit(0).cast("long")).alias("weight"),
    )
    return dealt.mapInPandas(folded, _ROW).groupBy("view", "kind", "shard").applyInPandasWithState(add, HELD, STATE, "update", GroupStateTimeout.NoTimeout)


def run_views(rows: DataFrame, budgets: dict[str, int], folder: str, name: str, *, shards: int = 16) -> DataFrame:
    """The last state of every (view, kind, shard) once the stream has come to its end."""
    return run_upserts(bounded_views(rows, budgets, shards=shards), ["view", "kind", "shard"], folder, name)


def snapshot(held: DataFrame, budgets: dict[str, int], hung: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """(view, kind, place, item, seen, weight, decoded, omitted): what each view shows, and how many rows of the kind it has met and does not show.

    hung: for a kind the other kind that it hangs on, and the array of that kind's items that one of it needs, over `item`. An
    item is shown only if all of those are. This is exact if its priority is the worst of theirs: then whatever
    hangs on shown items comes before all that does not, and no place was taken from it.
    """
    keys = ["view", "kind"]
    decoded = held.groupBy(*keys).agg(F.sum("decoded").alias("decoded"))
    rows = held.select(*keys, F.explode(F.arrays_zip("items", "priorities", "seen", "weights")).alias("_r")).select(
        *keys, F.col("_r.items").alias("item"), F.col("_r.priorities").alias("priority"), F.col("_r.seen").alias("seen"), F.col("_r.weights").alias("weight")
    )
    limit = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair])
    # At most `shards` times the budget of rows a window.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("priority", "item"))
    ranked = rows.withColumn("place", place).where(F.col("place") <= limit[F.col("kind")])
    for kind, (base, needs) in (hung or {}).items():
        shown = ranked.where(F.col("kind") == base).select("view", F.col("item").alias("_need"))
        asked = ranked.where(F.col("kind") == kind).select("view", "item", "priority", F.explode(F.array_distinct(needs)).alias("_need"))
        lacking = asked.join(shown, ["view", "_need"], "left_anti").select("view", F.lit(kind).alias("kind"), "item", "priority").distinct()
        ranked = ranked.join(lacking, ["view", "kind", "item", "priority"], "left_anti")
    out = ranked.withColumn("_shown", F.count(F.lit(1)).over(Window.partitionBy(*keys))).join(decoded, keys)
    return out.select(*keys, F.col("place").cast("int").alias("place"), "item", "seen", "weight", "decoded", (F.col("decoded") - F.col("_shown")).alias("omitted"))
