"""Digests of ordered rows that never gather more than a block of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 256
LEVELS = 3


def _node(label: Column, at: str, digest: str) -> Column:
    held = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(digest).alias("digest"))))
    return F.sha2(F.concat(label, F.lit(":"), F.count(F.lit(1)).cast("string"), F.lit(":"), F.array_join(F.transform(held, lambda x: x["digest"]), ",")), 256)


def tree_digest(rows: DataFrame, keys: Sequence[str], order: str, content: Column, *, levels: int = LEVELS) -> DataFrame:
    """keys, digest, leaves: a hash tree over the rows of each key in their order.

    order: a whole number from 0 on; rows that share one follow by their digests. A leaf hashes its content, a node how
    many children it has and their digests in order; what a digest stands for is part of it, so no leaf passes for a
    node, nor a node of one level for one of another. A node has the rows, or nodes, of `FAN` consecutive numbers, and
    the top what `levels` such levels leave, so a key of any length is a tree of small groups, and what changes shows
    in one path.
    """
    at = rows.select(*keys, F.col(order).cast("long").alias("_at"), F.sha2(F.concat(F.lit("leaf:"), content), 256).alias("_digest"))
    at = at.withColumn("_leaves", F.lit(1).cast("long"))
    for level in range(1, levels + 1):
        at = at.withColumn("_block", F.floor(F.col("_at") / FAN)).groupBy(*keys, "_block").agg(_node(F.lit(f"node {level}"), "_at", "_digest").alias("_digest"), F.sum("_leaves").alias("_leaves")).withColumnRenamed("_block", "_at")
    return at.groupBy(*keys).agg(_node(F.lit("top"), "_at", "_digest").alias("digest"), F.sum("_leaves").alias("leaves"))


def edge_digest(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, digest, leaves (nodes with edges): a tree over the handles that edges leave, each the tree of where they lead."""
    ends = tree_digest(edges, [*keys, "from_handle"], "to_handle", F.col("to_handle").cast("string"))
    return tree_digest(ends, keys, "from_handle", F.concat_ws(":", F.col("from_handle").cast("string"), "digest"))


def graph_digest(*parts: Column) -> Column:
    """One digest for the digests of a graph's nodes, edges and walk."""
    return F.sha2(F.concat(F.lit("graph:"), F.concat_ws(":", *[F.coalesce(p, F.lit("-")) for p in parts])), 256)
