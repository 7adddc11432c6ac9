"""Merkle dataset manifest: a postorder append log for each group of rows, and one over the groups.

A leaf is the hash of a row's columns. Leaves of a group (`lang`) ascend by `doc_id`; on every level two consecutive
nodes become the hash of both, and a last one without a neighbour the hash of itself, until one is left, the group's
subroot. The subroots, in order of their group (null first, then by UTF-8 bytes), become the root in the same way.

Nodes are kept in the order in which they are completed: a leaf when it arrives, an inner node right after the last
node below it. This log never changes as rows are appended, but for the nodes on the right edge that the end of the
group seals. Where a node stands follows from sizes of subtrees alone. With n leaves, the node `index` of `level`
covers the leaves from a = index * 2^level on, m = min(2^level, n - a) of them, and

    position = (2 a - ones(a)) + size(level, m) - 1,   size(level, m) = sum of ceil(m / 2^j) over j = 0 to level

(2 a - ones(a) nodes are complete before leaf a arrives). So siblings are read by address, and no node holds a pointer.

Builders are aligned: a chunk is 2^bits consecutive leaves of a group, and one builder writes its nodes in postorder as
one stretch of the log. The chunks' top nodes are the leaves of the next tier, which is built the same way, until a
group has one chunk. A proof joins the siblings inside a chunk with the path from the chunk's top, which the tier above
hands down, so nothing but leaves is ever as long as the table, no task holds more than a chunk, and a group of any
size is spread over its chunks. `log_entries` gives the whole log with its positions.

Cases: null columns count as `-`; rows without doc_id come first in their group; rows that share a doc_id are ordered
by their leaves, and rows equal in all columns are leaves of their own with equal digests; a group of one row has that
leaf as its subroot; an empty table gives no rows and no root; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

CHUNK_BITS = 8
CHUNK = "key string, chunk long, n long, count int, levels int, nodes binary, top binary"
PATH = "key string, place long, shape string, path binary"
DIGEST = 32


def size(level: int, leaves):
    """Nodes of a subtree of `level` over that many leaves."""
    leaves = np.asarray(leaves, np.int64)
    return sum(-(-leaves // (1 << j)) for j in range(level + 1))


def position(level: int, index, leaves: int):
    """Where the log of a tree over `leaves` leaves holds node `index` of `level`."""
    a = np.asarray(index, np.int64) << level
    return 2 * a - np.bitwise_count(a) + size(level, np.minimum(1 << level, leaves - a)) - 1


def height(leaves: int) -> int:
    return max(0, int(leaves) - 1).bit_length()


def digest(*hexes: bytes) -> bytes:
    """The hex digest of concatenated hex digests."""
    return hashlib.sha256(b"".join(hexes)).hexdigest().encode()


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """Hex digests of all nodes over the leaves, `levels` levels of them, in the order of their completion."""
    log: list[bytes] = []
    waiting: list[bytes | None] = [None] * (levels + 1)  # by level, the node that waits for its neighbour
    for leaf in leaves:
        node, level = leaf, 0
        log.append(node)
        while level < levels and waiting[level] is not None:
            node = digest(waiting[level], node)
            waiting[level] = None
            log.append(node)
            level += 1
        waiting[level] = node
    sealed = None
    for level in range(levels):
        below = [x for x in (waiting[level], sealed) if x is not None]
        sealed = digest(*below) if below else None
        if below:
            log.append(sealed)
    return log


def siblings(count: int, levels: int) -> np.ndarray:
    """at[level, leaf]: the position of the leaf's sibling on that level in the log, or -1."""
    leaf = np.arange(count)
    at = np.full((levels, count), -1, np.int64)
    for level in range(levels):
        other = (leaf >> level) ^ 1
        held = other << level < count
        at[level, held] = position(level, other[held], count)
    return at


def fold(leaf: bytes, shape: str, path: list[bytes]) -> bytes:
    """The root that a leaf and its siblings lead to. shape: for each level L or R, the sibling's side, or - without one."""
    at = 0
    for side in shape:
        if side == "-":
            leaf = digest(leaf)
            continue
        leaf = digest(path[at], leaf) if side == "L" else digest(leaf, path[at])
        at += 1
    return leaf


def _sides(count: int, at: np.ndarray) -> list[str]:
    """The shape of each leaf's path inside a chunk."""
    leaf = np.arange(count)
    marks = np.where(at < 0, "-", np.where((leaf >> np.arange(len(at))[:, None]) & 1, "L", "R"))
    return ["".join(column) for column in marks.T] if len(at) else [""] * count


def _raw(hexes: list[bytes]) -> bytes:
    return bytes.fromhex(b"".join(hexes).decode())


def _hexes(raw: bytes) -> list[bytes]:
    text = raw.hex().encode()
    return [text[i : i + 2 * DIGEST] for i in range(0, len(text), 2 * DIGEST)]


def _write_chunk(bits: int):
    def run(key, rows):
        order = np.argsort(rows.column("place").to_numpy(), kind="stable")
        leaves = _hexes(b"".join(rows.column("digest").take(pa.array(order)).to_pylist()))
        n = rows.column("n")[0].as_py()
        levels = min(bits, height(n))
        log = append_log(leaves, levels)
        held = {"key": key[0], "chunk": key[1], "n": n, "count": len(leaves), "levels": levels, "nodes": _raw(log), "top": _raw(log[-1:])}
        kinds = {"n": pa.int64(), "count": pa.int32(), "levels": pa.int32(), "nodes": pa.binary(), "top": pa.binary()}
        return pa.table({k: pa.array([v], kinds.get(k)) if k in kinds else pa.array([v.as_py()], v.type) for k, v in held.items()})

    return run


class Log:
    """The log of each key in tiers of chunks: key, chunk, n (leaves of the key in the tier), count, levels, nodes, top."""

    def __init__(self, tiers: list[DataFrame], bits: int):
        self.tiers, self.bits = tiers, bits

    @classmethod
    def build(cls, leaves: DataFrame, *, bits: int = CHUNK_BITS, name: str = "manifest-log") -> Log:
        """leaves: key, place (gapless from 0 within the key), digest (32 bytes), n (leaves of the key)."""
        tiers: list[DataFrame] = []
        while True:
            chunks = leaves.withColumn("chunk", F.shiftright("place", bits)).groupBy("key", "chunk").applyInArrow(_write_chunk(bits), CHUNK)
            tiers.append(materialize(chunks, name))
            above = tiers[-1].where(F.col("n") > 1 << bits)
            if not above.limit(1).count():
                return cls(tiers, bits)
            leaves = above.select("key", F.col("chunk").alias("place"), F.col("top").alias("digest"), F.ceil(F.col("n") / (1 << bits)).alias("n"))

    def _closed(self, tier: int) -> Column:
        """Whether a chunk is its key's only one in the tier."""
        return F.col("n") <= 1 << self.bits

    def roots(self) -> DataFrame:
        """(key, root)"""
        found = [t.where(self._closed(i)).select("key", F.col("top").alias("root")) for i, t in enumerate(self.tiers)]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def with_paths(self, tier: int, start: DataFrame) -> DataFrame:
        """The tier's chunks with the path from their top to the root: `shape`, `path`. start: (key, shape, path) of the keys' roots."""
        chunks = self.tiers[tier]
        closed = chunks.where(self._closed(tier)).join(start, "key")
        if tier + 1 == len(self.tiers):
            return closed
        above = self.with_paths(tier + 1, start).mapInArrow(_hand_down, PATH).withColumnRenamed("place", "chunk")
        return chunks.where(~self._closed(tier)).join(materialize(above, "manifest-paths"), ["key", "chunk"]).select(closed.columns).unionByName(closed)

    def leaf_paths(self, start: DataFrame) -> DataFrame:
        """(key, place, shape, path) of every leaf. For few leaves; `Manifest.proofs` folds without writing paths."""
        return self.with_paths(0, start).mapInArrow(_hand_down, PATH)

    def entries(self) -> DataFrame:
        """key, level, index, position, digest: each node once, where the log of the whole key holds it."""
        found = []
        for i, t in enumerate(self.tiers):
            whole = self.tiers[0].groupBy("key").agg(F.max("n").alias("leaves"))
            found.append(t.join(whole, "key").mapInArrow(partial(_entries, i, self.bits), "key string, level int, index long, position long, digest binary"))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each leaf of each chunk the siblings inside the chunk and then the chunk's own path."""
    for batch in batches:
        for row in batch.to_pylist():
            at = siblings(row["count"], row["levels"])
            shapes = [s + row["shape"] for s in _sides(row["count"], at)]
            nodes, first = row["nodes"], row["chunk"] * _chunk_size(row)
            paths = [b"".join(nodes[DIGEST * p : DIGEST * (p + 1)] for p in column if p >= 0) + row["path"] for column in at.T.tolist()] if len(at) else [row["path"]] * row["count"]
            places = pa.array(np.arange(first, first + row["count"]))
            yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * row["count"]), places, pa.array(shapes), pa.array(paths, pa.binary())], ["key", "place", "shape", "path"])


def _chunk_size(row: dict) -> int:
    """Leaves of a whole chunk; a chunk that is not the only one has as many levels as whole ones."""
    return 1 << row["levels"]


def _entries(tier: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            count = row["count"]
            for level in range(0 if tier == 0 else 1, row["levels"] + 1):  # a tier's leaves stand in the tier below
                index = np.arange(-(-count // (1 << level)))
                at = position(level, index, count)
                above = index + (row["chunk"] * _chunk_size(row) >> level)
                place = position(tier * bits + level, above, row["leaves"])
                raw = [row["nodes"][DIGEST * p : DIGEST * (p + 1)] for p in at.tolist()]
                n = len(index)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]] * n), pa.array(np.full(n, tier * bits + level, np.int32)), pa.array(above), pa.array(place), pa.array(raw, pa.binary())],
                    ["key", "level", "index", "position", "digest"],
                )


def row_digest(*columns: Column) -> Column:
    """The hex digest of a row: `-` for null, else UTF-8 byte count, colon, value."""
    held = []
    for c in columns:
        text = c.cast("string")
        held.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*held), 256)


def group_key(group: Column) -> Column:
    """A group as a text that is never null and sorts as the groups do, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


_PROOF = "leaf string, subroot string, proof_sha256 string, folded_root string"


class Manifest:
    """leaves: id, key, leaf, claimed, place; groups: the log over each key; top: the log over the subroots; root: hex, or None."""

    def __init__(self, leaves: DataFrame, groups: Log, top: Log, order: DataFrame, root: str | None):
        self.leaves, self.groups, self.top, self.order, self.root = leaves, groups, top, order, root

    def subroots(self) -> DataFrame:
        return self.groups.roots().withColumnRenamed("root", "subroot")

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row's claim against the manifest."""
        start = self.top.leaf_paths(self.order.limit(1).select(F.lit("").alias("key"), F.lit("").alias("shape"), F.lit(b"").alias("path")))
        start = self.order.join(start.drop("key"), "place").select("key", "shape", "path")
        chunks = self.groups.with_paths(0, start).join(self.subroots(), "key").drop("top", "n")
        leaves = self.leaves.withColumn("chunk", F.shiftright("place", self.groups.bits))
        id_type = leaves.schema["doc_id"].dataType.simpleString()
        told = leaves.groupBy("key", "chunk").cogroup(chunks.groupBy("key", "chunk")).applyInArrow(_prove, f"doc_id {id_type}, {_PROOF}")
        root = F.lit(self.root).cast("string")
        return told.withColumn("root", root).withColumn("verified", F.col("folded_root") == root)


def _prove(leaves: pa.Table, chunks: pa.Table) -> pa.Table:
    (row,) = chunks.to_pylist()
    order = np.argsort(leaves.column("place").to_numpy(), kind="stable")
    leaves = leaves.take(pa.array(order))
    at = siblings(row["count"], row["levels"])
    nodes, upper = _hexes(row["nodes"]), _hexes(row["path"])
    proofs, folded = [], []
    inside = at.T.tolist() if len(at) else [[]] * row["count"]
    claims = _hexes(b"".join(leaves.column("claimed").to_pylist()))
    for claim, shape, own in zip(claims, _sides(row["count"], at), inside, strict=True):
        path = [nodes[p] for p in own if p >= 0] + upper
        proofs.append(digest(*path).decode())
        folded.append(fold(claim, shape + row["shape"], path).decode())
    held = [x.decode() for x in _hexes(b"".join(leaves.column("digest").to_pylist()))]
    return pa.table([leaves.column("doc_id"), pa.array(held), pa.array([row["subroot"].hex()] * len(held)), pa.array(proofs), pa.array(folded)], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def build(docs: DataFrame, leaf: Column, claimed: Column, *, group: str = "lang", bits: int = CHUNK_BITS) -> Manifest:
    """The manifest of docs. leaf: the hex digest of a row; claimed: that of the row as somebody else holds it."""
    rows = docs.select("doc_id", group_key(F.col(group)).alias("key"), F.unhex(leaf).alias("digest"), F.unhex(claimed).alias("claimed"))
    rows = materialize(rows, "manifest-rows")
    leaves = materialize(numbered(rows, ["key"], ["doc_id", "digest", "claimed"], "manifest-order").withColumnRenamed("total", "n"), "manifest-leaves")
    groups = Log.build(leaves.select("key", "place", "digest", "n"), bits=bits)
    roots = materialize(groups.roots(), "manifest-subroots")
    order = materialize(numbered(roots, [], ["key"], "manifest-groups").withColumnRenamed("total", "n"), "manifest-groups")
    top = Log.build(order.select(F.lit("").alias("key"), "place", F.col("root").alias("digest"), "n"), bits=bits, name="manifest-top")
    root = top.roots().head()  # one row
    return Manifest(leaves, groups, top, order.select("key", "place"), root["root"].hex() if root else None)
