"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents with equal text form a group that must stay in one shard. Groups are dealt to buckets by a hash
of the text. Within a bucket every group starts as a partial partition (its bytes in one part, the other
parts empty); the two partial partitions with the largest spread are combined, one in falling and the
other in rising order of bytes, until one is left. Each bucket thus returns k parts, again a partial
partition, and the same differencing combines the buckets: first within bundles of buckets, then the
bundles. A bucket holds about `bucket_groups` groups and a bundle `bundle_buckets` buckets, so every task
has a bounded share; the last step sees one row of k numbers for `bucket_groups * bundle_buckets` groups.

Groups too large for their bucket to make up for, giants, are differenced by themselves, in chests of
`bucket_groups` of them and then chest by chest. The imbalance they leave is handed in equal shares, as one more partial partition, to as many buckets as it takes to fill
it. Those buckets and the giants then count as one partial partition among the other buckets'.

Spreads shrink at every combination, so the final byte counts differ by far less than one group unless a
single group outweighs the average shard.

Cases: a null text has size 1 and its rows are a group of their own; empty texts are a group; repeated
rows are members like any others; extra columns, whatever their names, are ignored; an empty table gives no
rows; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BUCKET_GROUPS = 20_000
BUNDLE_BUCKETS = 1_000


def difference(parts: np.ndarray) -> np.ndarray:
    """parts[i, j]: bytes in slot j of partial partition i. Returns into[i, j]: the final part that takes that slot.

    Karmarkar-Karp for k parts; equal spreads are combined in order of position.
    """
    n, k = parts.shape
    if n == 0:
        return np.zeros((0, k), np.int64)
    # A node: rising sums, and for each of its slots the slots of its two children that it joins.
    heap = []
    order = np.argsort(parts, axis=1, kind="stable")
    for i in range(n):
        sums = parts[i, order[i]].tolist()
        heap.append((sums[0] - sums[-1], i, sums))
    heapq.heapify(heap)
    joins: list[tuple[int, int, list[int]]] = []
    number = n
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        added = [x[j] + y[k - 1 - j] for j in range(k)]
        at = sorted(range(k), key=added.__getitem__)
        joins.append((a, b, at))
        sums = [added[j] for j in at]
        heapq.heappush(heap, (sums[0] - sums[-1], number, sums))
        number += 1
    # From the last node down: slot j of a node ends in final part `ends[node][j]`.
    ends: list[list[int] | None] = [None] * number
    ends[number - 1] = list(range(k))
    for m in range(len(joins) - 1, -1, -1):
        a, b, at = joins[m]
        mine = ends[n + m]
        left, right = [0] * k, [0] * k
        for j, old in enumerate(at):
            left[old] = mine[j]
            right[k - 1 - old] = mine[j]
        ends[a], ends[b] = left, right
        ends[n + m] = None
    into = np.zeros((n, k), np.int64)
    for i in range(n):
        into[i, order[i]] = ends[i]
    return into


def _within_bucket(shards: int, lean: np.ndarray, tied: int):
    """The first `tied` buckets make up for the giants: they share lean[s], the bytes of giants in part s, and their
    parts are named as the giants' are. They leave as bucket -1, the giants' own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group", kind="stable")
        bucket = int(pdf["bucket"].iloc[0])
        parts = np.zeros((len(pdf) + 1, shards), np.int64)
        parts[:-1, 0] = pdf["bytes"]
        if bucket < tied:
            parts[-1] = lean // tied
        into = difference(parts)
        named = np.argsort(into[-1])  # a part is named by the slot of `lean` that it holds
        return pd.DataFrame({"bucket": np.int32(-1 if bucket < tied else bucket), "group": pdf["group"].to_numpy(), "part": named[into[:-1, 0]].astype(np.int32), "bytes": pdf["bytes"].to_numpy()})

    return run


def _giants(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group", kind="stable")
        parts = np.zeros((len(pdf), shards), np.int64)
        parts[:, 0] = pdf["bytes"]
        return pd.DataFrame({"chest": pdf["chest"].to_numpy(), "group": pdf["group"].to_numpy(), "bytes": pdf["bytes"].to_numpy(), "own": difference(parts)[:, 0].astype(np.int32)})

    return run


def _place_giants(giants: DataFrame, shards: int, bucket_groups: int) -> DataFrame:
    """giants (group, bytes) -> (group, bytes, part): differenced in chests of bounded size, and then the chests."""
    chests = max(1, -(-giants.count() // bucket_groups))
    dealt = giants.withColumn("chest", F.pmod(F.xxhash64("group"), F.lit(chests)).cast("int"))
    low = materialize(dealt.groupBy("chest").applyInPandas(_giants(shards), "chest int, group binary, bytes long, own int"), "shard-giants")
    sums = low.groupBy("chest", F.col("own").alias("part")).agg(F.sum("bytes").alias("bytes"))
    where = sums.groupBy(F.lit(0).alias("all")).applyInPandas(_combine("chest", shards), "chest int, part int, into int")  # a row a chest and part
    where = where.select("chest", F.col("part").alias("own"), F.col("into").alias("part"))
    return materialize(low.join(where, ["chest", "own"]).select("group", "bytes", "part"), "shard-giants")


def _combine(key: str, shards: int):
    """Pandas function over rows (key, part, bytes): the part of the combination that each (key, part) goes to."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=key, columns="part", values="bytes", aggfunc="sum", fill_value=0).reindex(columns=range(shards), fill_value=0).sort_index()
        into = difference(wide.to_numpy(np.int64))
        return pd.DataFrame({key: np.repeat(wide.index.to_numpy(), shards), "part": np.tile(np.arange(shards, dtype=np.int32), len(wide)), "into": into.reshape(-1).astype(np.int32)})

    return run


def assign_groups(groups: DataFrame, shards: int, bucket_groups: int = BUCKET_GROUPS, bundle_buckets: int = BUNDLE_BUCKETS) -> DataFrame:
    """groups (group binary, bytes) -> (group, shard)."""
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).head()
    n_buckets = max(1, -(-n // bucket_groups))
    # A group above half of what a bucket has for a shard is a giant: at most 2 * shards of them a bucket.
    limit = total // (2 * shards * n_buckets) if n_buckets > 1 else total
    giants = _place_giants(groups.where(F.col("bytes") > limit).select("group", "bytes"), shards, bucket_groups)
    lean = np.zeros(shards, np.int64)
    for r in giants.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect():  # a row a shard
        lean[r["part"]] = r["bytes"]
    lean -= lean.min()
    tied = min(n_buckets, -(-int(lean.max()) // max(1, limit)))
    dealt = groups.where(F.col("bytes") <= limit).withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(n_buckets)).cast("int"))
    low = dealt.groupBy("bucket").applyInPandas(_within_bucket(shards, lean, tied), "bucket int, group binary, part int, bytes long")
    low = materialize(low.unionByName(giants.select(F.lit(-1).alias("bucket"), "group", "part", "bytes")), "shard-buckets")
    bundle = F.floor(F.col("bucket") / bundle_buckets).cast("int").alias("bundle")
    by_bucket = materialize(low.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")), "shard-sums").select("*", bundle)
    mid = materialize(by_bucket.groupBy("bundle").applyInPandas(_combine("bucket", shards), "bucket int, part int, into int"), "shard-bundles").select("*", bundle)
    by_bundle = by_bucket.join(mid.drop("bundle"), ["bucket", "part"]).groupBy("bundle", F.col("into").alias("part")).agg(F.sum("bytes").alias("bytes"))
    top = by_bundle.groupBy(F.lit(0).alias("all")).applyInPandas(_combine("bundle", shards), "bundle int, part int, into int").withColumnRenamed("into", "shard")
    where = materialize(mid.join(top.withColumnRenamed("part", "into"), ["bundle", "into"]).select("bucket", "part", "shard"), "shard-map")
    return low.join(where, ["bucket", "part"]).select("group", "shard")


def number_within(rows: DataFrame, key: str, by: list[str], slices: int = 256) -> DataFrame:
    """Adds `slot`, gapless from 0 within each value of `key`, without sorting a whole value in one task.

    Rows are numbered within slices of a hash; each slice starts where the ones before it end. There are
    `slices` counts for each value of key, however many rows there are.
    """
    cut = rows.withColumn("_slice", F.pmod(F.xxhash64(*by), F.lit(slices)).cast("int"))
    counts = cut.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(key, "_slice").orderBy(*by)
    numbered = cut.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), [key, "_slice"]).withColumn("slot", F.col("_start") + F.col("_at")).drop("_slice", "_start", "_at")


def shard_documents(docs: DataFrame, shards: int = 8, **options) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every document. Sizes are UTF-8 bytes plus 1."""
    text = F.col("text")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.sha2(text, 256))).alias("group"),
    )
    sized = materialize(sized, "shard-sizes")
    groups = materialize(sized.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    where = materialize(assign_groups(groups, shards, **options), "shard-where")
    placed = materialize(sized.join(where, "group").drop("group"), "shard-placed")
    return number_within(placed, "shard", ["doc_id", "text_crc32", "size"])
