"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The top of the tree is fitted on a sample of about `sample_rows` vectors and is broadcast. Every row of the table
is filed under the leaf that it falls into. While leaves hold over `split_rows` rows, each of those is split by a tree
of its own, fitted on a sample of its rows, and its rows and the queries that visit it are sent on below it: the tree
grows with the table, and a query reads a bounded number of leaves of bounded size a level. A query visits leaves
through a priority queue of tree nodes ordered by their centre's distance; how many leaves is calibrated on each
tree's sample: visits are widened until the share of true neighbours found reaches that level's part of `recall`, of
which the levels that the table's size asks for make up the product. A query takes leaves until they hold k rows
besides its own, on every level. After `max_levels` levels, or where rows are all alike, leaves stay large.

Rows of a leaf are dealt to chunks of bounded size, however many there are, and the queries of a chunk to
batches of bounded size, so a leaf that holds a third of all rows is many units of work. Distances are exact.

Cases: a vector that is null, zero, or holds a null or a non-finite component takes no part, nor does a null
id, nor a vector whose length differs from the commonest length; repeated ids are rows of their own, a query
never meets a row of its own id, and a repeated query id is asked once, with its smallest vector; ties go to
the smaller id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of two numbers a leaf that may be broadcast; more are joined by shuffling.
MOST_BROADCAST_LEAVES = 500_000


@dataclass
class Tree:
    """Node 0 is the root; a node without children is a leaf, with its number in `leaf`."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0
    held: list[int] = field(default_factory=list)  # rows of the sample in each leaf: at least so many are in the table

    def add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.centres) - 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                nearest = _nearest(x[rows], np.stack([self.centres[c] for c in self.children[node]]))
                todo += [(c, rows[nearest == i]) for i, c in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray, most: int, sizes: list[int] | None = None, least_rows: int = 0) -> list[int]:
        """Leaves in best-bin-first order: `most` of them, and more while they hold under `least_rows` rows."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < least_rows):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf[node])
                held += sizes[self.leaf[node]] if sizes else 0
                continue
            far = ((np.stack([self.centres[c] for c in kids]) - q) ** 2).sum(axis=1)
            for d, c in zip(far.tolist(), kids, strict=True):
                heapq.heappush(queue, (d, c))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)


def build_tree(x: np.ndarray, *, branch: int, leaf_rows: int, rounds: int, seed: int) -> Tree:
    rng, tree = np.random.default_rng(seed), Tree()
    tree.add(x.mean(axis=0) if len(x) else np.zeros(x.shape[1]))
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        part = x[rows]
        different = np.unique(part, axis=0) if len(rows) > leaf_rows else part[:1]
        if len(rows) <= leaf_rows or len(different) < 2:
            tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
            continue
        centres = different[rng.choice(len(different), min(branch, len(different)), replace=False)]
        for _ in range(rounds):
            of = _nearest(part, centres)
            centres = np.stack([part[of == i].mean(axis=0) if (of == i).any() else centres[i] for i in range(len(centres))])
        of = _nearest(part, centres)
        held = [i for i in range(len(centres)) if (of == i).any()]
        if len(held) < 2:
            tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
            continue
        for i in held:
            child = tree.add(centres[i])
            tree.children[node].append(child)
            todo.append((child, rows[of == i]))
    return tree


def calibrate(tree: Tree, x: np.ndarray, *, k: int, recall: float, probes: int, seed: int) -> int:
    """Leaf visits at which the sample's own neighbours are found with the given recall."""
    if len(x) < 2:
        return tree.leaves
    leaf = tree.file(x)
    where = np.zeros(tree.leaves, np.int64)
    ranks = []
    for i in np.random.default_rng(seed).choice(len(x), min(probes, len(x)), replace=False):
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        near = np.argpartition(far, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        order = tree.visit(x[i], tree.leaves)
        where[order] = np.arange(len(order))
        ranks += where[leaf[near]].tolist()
    ranks = np.sort(ranks)
    visits = 1
    while np.searchsorted(ranks, visits - 1, "right") / len(ranks) < recall:  # widen
        visits += max(1, visits // 16)
    return min(visits, tree.leaves)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: v.cast("double")).alias("x")
    )
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("x") == (common[0]["n"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 1))


def _distances(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            ids, x = rows["vec_id"].to_numpy(), np.stack(rows["x"])
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for qid, q in zip(queries["query_id"].to_numpy(), queries["q"], strict=True):
                far = np.sqrt(((x - q) ** 2).sum(axis=1))  # may be infinite
                others = np.flatnonzero(ids != qid)
                held = far[others]
                best = others[np.argsort(held, kind="stable")[:k] if len(held) <= 4 * k else _smallest(held, k)]
                out.append((np.full(len(best), qid), ids[best], far[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return run


def _smallest(far: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest, ties by position."""
    limit = np.partition(far, k - 1)[k - 1]
    near = np.flatnonzero(far <= limit)
    return near[np.argsort(far[near], kind="stable")][:k]


def _leaf_tree(x: np.ndarray, *, branch: int, leaf_rows: int, k: int, recall: float, probes: int, seed: int) -> tuple[Tree, int]:
    tree = build_tree(x, branch=branch, leaf_rows=leaf_rows, rounds=6, seed=seed)
    tree.held = np.bincount(tree.file(x), minlength=tree.leaves).tolist()
    return tree, calibrate(tree, x, k=k, recall=recall, probes=probes, seed=seed)


def planned_levels(n: int, *, sample_rows: int, leaf_rows: int, split_rows: int, most: int) -> int:
    """Levels that n rows take: a tree has about sample_rows / leaf_rows leaves, of which some hold four times their share."""
    fan, levels, room = max(2, sample_rows // leaf_rows), 1, split_rows * max(2, sample_rows // leaf_rows)
    while 4 * n > room and levels < most:
        levels, room = levels + 1, room * fan
    return levels


#: A leaf's children are numbered within so many, more than a tree's sample has rows; four levels of them fit a long.
_FAN = 1 << 15


def _grow(index: DataFrame, plans: DataFrame, big: DataFrame, options: dict, sample_rows: int, chunk_rows: int, batch_queries: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """Splits the leaves in `big` (leaf, rows) by a tree each, fitted on a sample of the leaf, and sends queries on below them."""

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        tree, visits = _leaf_tree(_matrix(rows.column("x").combine_chunks()), **options)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([pickle.dumps(tree)]), pa.array([visits], pa.int32())], ["leaf", "tree", "visits"])

    def load(trees: pa.Table) -> tuple[Tree, int]:
        return pickle.loads(trees.column("tree")[0].as_py()), trees.column("visits")[0].as_py()

    def file(key: tuple, rows: pa.Table, trees: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["vec_id", "x", "leaf"])
        tree, _ = load(trees)
        leaf = tree.file(_matrix(rows.column("x").combine_chunks())).astype(np.int64) + (key[0].as_py() + 1) * _FAN
        return pa.table([rows.column("vec_id"), rows.column("x"), pa.array(leaf)], ["vec_id", "x", "leaf"])

    def visit(key: tuple, rows: pa.Table, trees: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["query_id", "q", "leaf"])
        tree, most = load(trees)
        leaves = [tree.visit(q, most, tree.held, options["k"] + 1) for q in _matrix(rows.column("q").combine_chunks())]
        at = np.repeat(np.arange(rows.num_rows), [len(x) for x in leaves])
        leaf = np.concatenate(leaves).astype(np.int64) + (key[0].as_py() + 1) * _FAN
        return pa.table([rows.column("query_id").take(pa.array(at)), rows.column("q").take(pa.array(at)), pa.array(leaf)], ["query_id", "q", "leaf"])

    def dealt(rows: DataFrame, by: str, size: int) -> tuple[DataFrame, DataFrame]:
        """rows of big leaves with a chunk number, and the trees once for each chunk."""
        chunks = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("chunks")).join(trees, "leaf").select("leaf", "chunks")
        chunks = materialize(chunks, "ann-chunks")
        cut = rows.join(few(chunks), "leaf").withColumn("chunk", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int")).drop("chunks")
        return cut, trees.join(chunks, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    # A row a big leaf, of over split_rows rows each: sent to all tasks only while they are few.
    few = F.broadcast if big.count() <= MOST_BROADCAST_LEAVES else lambda rows: rows
    share = F.col("rows") * F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 20)) < F.lit(sample_rows) * (1 << 20)
    picked = index.join(few(big), "leaf").where(share).select("leaf", "x")
    trees = materialize(picked.groupBy("leaf").applyInArrow(fit, "leaf long, tree binary, visits int"), "ann-trees")
    out = []
    for rows, by, size, step, schema in (
        (index, "vec_id", 4 * chunk_rows, file, "vec_id long, x array<double>, leaf long"),
        (plans, "query_id", batch_queries, visit, "query_id long, q array<double>, leaf long"),
    ):
        cut, sent = dealt(rows, by, size)
        below = cut.groupBy("leaf", "chunk").cogroup(sent.groupBy("leaf", "chunk")).applyInArrow(step, schema)
        out.append(materialize(rows.join(few(trees.select("leaf")), "leaf", "left_anti").select(below.columns).unionByName(below), "ann-grown"))
    return out[0], out[1]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 10,
    recall: float = 0.97,
    sample_rows: int = 10_000,
    branch: int = 8,
    leaf_rows: int = 64,
    split_rows: int = 8_192,
    max_levels: int = 4,
    probes: int = 200,
    chunk_rows: int = 4_096,
    batch_queries: int = 1_024,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest rows found for every query. is_query: a predicate on vec_id."""
    rows = usable(vectors)
    n = rows.count()
    share = min(1.0, sample_rows / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).orderBy("vec_id").select("x").toArrow()  # about sample_rows rows
    x = _matrix(sample.column("x").combine_chunks()) if sample.num_rows else np.zeros((0, 1))
    levels = planned_levels(n, sample_rows=sample_rows, leaf_rows=leaf_rows, split_rows=split_rows, most=max_levels)
    options = {"branch": branch, "leaf_rows": leaf_rows, "k": k, "recall": recall ** (1 / levels), "probes": probes, "seed": seed}
    tree, visits = _leaf_tree(x, **options)
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.file(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int64))], ["vec_id", "x", "leaf"])

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("q"))
            leaves = [shared.value.visit(q, visits, sizes, k + 1) for q in x] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], ["query_id", "q", "leaves"])

    index = materialize(rows.mapInArrow(filed, "vec_id long, x array<double>, leaf long"), "ann-index")
    counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # a row a leaf of the first tree
    sizes = [counts.get(i, 0) for i in range(tree.leaves)]
    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("q"))
    plans = asked.mapInArrow(planned, "query_id long, q array<double>, leaves array<long>").select("query_id", "q", F.explode("leaves").alias("leaf"))
    plans = materialize(plans, "ann-plans")
    for level in range(1, max_levels):
        big = materialize(index.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > split_rows), "ann-big")
        if not big.limit(1).count():
            break
        # A level that only crowded leaves need loses next to nothing more.
        own = options if level < levels else options | {"recall": max(options["recall"], 0.995)}
        index, plans = _grow(index, plans, big, own, sample_rows, chunk_rows, batch_queries, seed + level)

    visitors = plans.groupBy("leaf").count()
    # A row a leaf: into how many chunks and batches its rows and queries are dealt.
    deal = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks")).join(visitors, "leaf").select("leaf", "chunks", F.ceil(F.col("count") / batch_queries).cast("int").alias("batches"))
    deal = materialize(deal, "ann-deal")
    deal = F.broadcast(deal) if deal.count() <= MOST_BROADCAST_LEAVES else deal
    dealt = index.join(deal, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"), "vec_id", "x")
    sent = (
        plans.join(deal, "leaf")
        .select("leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("query_id"), F.col("batches")).cast("int").alias("batch"), "query_id", "q")
    )
    keys = ["leaf", "chunk", "batch"]
    found = dealt.groupBy(keys).cogroup(sent.groupBy(keys)).applyInPandas(_distances(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
