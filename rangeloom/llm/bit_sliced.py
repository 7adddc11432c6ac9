"""Exact top-k search by inner product over a bit-sliced index.

Vectors become integers, `floor(scale * x)`. The index cuts the rows into blocks and stores, for each
dimension, one bitmap per binary digit of (value - smallest value of that dimension in the block). It is written
once; queries are sent to the blocks.

A query is answered block by block:

* every query component is split into binary digits too; a dimension with a negative component uses the
  complement bitmaps, so all terms are additions. The bitmaps that carry the same power of two are added
  with full adders (two bitwise sums and a majority over whole bitmaps), which leaves one bitmap per
  binary digit of the score;
* from the most significant score slice downwards, rows with a one are taken while they fit into k; the
  slice at which more than k rows remain narrows the candidates instead. What remains open after the last
  slice is a tie on the whole score, resolved by the smaller id;
* the few rows selected get their score from the stored integers.

The queries meet the blocks of rows in a cogroup on the block number, `unit_queries` of them at a time; each block
returns at most k rows a query, and a window keeps the best k of those.

Cases: a vector that is null or holds a null or a non-finite component takes no part, nor does a null id;
shorter vectors count as if padded with zeros; repeated ids are rows of their own, but a query never meets
a row of its own id, and a repeated query id is asked once, with its smallest vector; ties go to the smaller id;
extra columns are ignored; an empty table gives no rows. Components beyond a long once scaled are the largest or
smallest long, and so are scores beyond it; scores within it are exact whatever the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK_ROWS = 8192
UNIT_QUERIES = 16_384
BLOCK = "block int, n int, width int, ids binary, q binary, low binary, digits binary, slices binary"
LONG = np.iinfo(np.int64)


def quantise(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, q): the integer vectors that take part."""
    x = F.col("embedding")
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("q")
    )


def _stack(arrays: list, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width), np.int64)
    for row, a in zip(out, arrays, strict=True):
        row[: len(a)] = a
    return out


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """One block of rows, ordered by id so that early bits are small ids, with its bitmaps."""
    rows = rows.sort_by("vec_id")
    vectors = rows.column("q").to_pylist()
    q = _stack(vectors, max(map(len, vectors), default=0))
    ids = rows.column("vec_id").to_numpy().astype("<i8")
    low, digits, slices = slice_rows(q)
    cells = [[key[0].as_py()], [len(ids)], [q.shape[1]], *[[x.tobytes()] for x in (ids, q, low, digits, slices)]]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])


def slice_rows(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least value of each dimension, its number of binary digits above that, and the bitmaps, dimension by dimension."""
    n, width = q.shape
    low = q.min(axis=0) if n else np.zeros(width, np.int64)
    offset = q.view(np.uint64) - low.view(np.uint64)  # wraps around to the true difference
    digits = np.array([int(v).bit_length() for v in offset.max(axis=0)] if n else [0] * width, np.int64)
    maps = [_bitmap((offset[:, d] >> np.uint64(j)) & np.uint64(1)) for d in range(width) for j in range(digits[d])]
    return low, digits, np.stack(maps) if maps else np.zeros((0, -(-n // 64)), np.uint64)


def _bitmap(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(-(-len(bits) // 64) * 8, np.uint8)
    packed = np.packbits(bits.astype(np.uint8), bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def blocks(rows: DataFrame, count: int) -> DataFrame:
    """rows dealt to `count` blocks by a hash of the id."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
    return dealt.groupBy("block").applyInArrow(_pack, BLOCK)


class BitSlicedBlock:
    """The bitmaps of one block, packed into 64-bit words."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, digits: np.ndarray, slices: np.ndarray):
        self.ids, self.q, self.n = ids, q, len(ids)
        self.words = -(-self.n // 64)
        ends = np.cumsum([0, *digits])
        self.slices = [slices[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.all = _bitmap(np.ones(self.n, np.uint8))
        self.largest = max(abs(int(q.min(initial=0))), int(q.max(initial=0)))

    @classmethod
    def of(cls, row: dict) -> BitSlicedBlock:
        n, width = row["n"], row["width"]
        read = lambda c, t: np.frombuffer(row[c], t)
        return cls(read("ids", "<i8"), read("q", "<i8").reshape(n, width), read("digits", "<i8"), read("slices", "<u8").reshape(-1, -(-n // 64)))

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact scores of rows, within the range of a long."""
        rows = self.q[at]
        if self.largest * max(map(abs, query.tolist()), default=0) * max(1, len(query)) <= LONG.max:
            return rows @ query
        exact = [sum(a * b for a, b in zip(r, query.tolist(), strict=True)) for r in rows.tolist()]
        return np.array([min(max(x, LONG.min), LONG.max) for x in exact], np.int64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of (score - a constant of query and block), least significant first."""
        columns: dict[int, list[np.ndarray]] = {}
        for d, c in enumerate(query.tolist()):
            for i in range(abs(c).bit_length()):
                if abs(c) >> i & 1:
                    for j, s in enumerate(self.slices[d]):
                        columns.setdefault(i + j, []).append(s if c > 0 else ~s)
        out, power = [], 0
        carried: list[np.ndarray] = []
        last = max(columns, default=-1)
        while power <= last or carried:
            level = columns.get(power, [])
            pile = [np.stack(level)] if level else []
            pile += carried
            pile = np.concatenate(pile) if pile else np.zeros((0, self.words), np.uint64)
            carried = []
            while len(pile) > 2:
                third = len(pile) // 3
                a, b, c = pile[:third], pile[third : 2 * third], pile[2 * third : 3 * third]
                ab = a ^ b
                carried.append((a & b) | (ab & c))
                pile = np.concatenate([ab ^ c, pile[3 * third :]])
            if len(pile) == 2:
                carried.append((pile[0] & pile[1])[None])
                pile = (pile[0] ^ pile[1])[None]
            out.append(pile[0] if len(pile) else np.zeros(self.words, np.uint64))
            power += 1
        return out

    def top(self, query: np.ndarray, own: int, k: int) -> np.ndarray:
        """Positions of the best k rows by score, then by smaller id, without the rows of id `own`."""
        open_ = self.all.copy()
        first, last = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        for p in range(first, last):
            open_[p // 64] &= ~(np.uint64(1) << np.uint64(p % 64))
        taken, n = np.zeros_like(open_), 0
        for s in reversed(self.score_slices(query)):
            ones = open_ & s
            count = int(np.bitwise_count(ones).sum())
            if n + count > k:
                open_ = ones
            else:
                taken, n, open_ = taken | ones, n + count, open_ & ~s
            if n == k:
                return self._positions(taken)
        ties = self._positions(open_)[: k - n]
        return np.concatenate([self._positions(taken), ties])

    def _positions(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _search(k: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros((3, 0), np.int64)]
        if rows.num_rows and queries.num_rows:
            index = BitSlicedBlock.of(rows.to_pylist()[0])
            width = index.q.shape[1]
            for qid, q in zip(queries.column("query_id").to_pylist(), queries.column("q").to_pylist(), strict=True):
                query = _stack([q[:width]], width)[0]  # what one side lacks counts as zero
                at = index.top(query, qid, k)
                out.append(np.stack([np.full(len(at), qid), index.ids[at], index.scores(at, query)]))
        return pa.table(list(np.concatenate(out, axis=1)), ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, block_rows: int = BLOCK_ROWS, unit_queries: int = UNIT_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query over all other rows.

    is_query is a predicate on vec_id. Work is queries times rows, cut into units of bounded size.
    """
    rows = quantise(vectors, scale)
    asked = materialize(rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("q").alias("q")), "search-queries")
    n, m = rows.count(), asked.count()
    count, units = max(1, -(-n // block_rows)), max(1, -(-m // unit_queries))
    index = materialize(blocks(rows, count), "bit-slices")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = asked.withColumn("unit", F.pmod(F.xxhash64("query_id"), F.lit(units)).cast("int")).withColumn("block", each(count))
    met = index.withColumn("unit", each(units)).groupBy("block", "unit").cogroup(sent.groupBy("block", "unit"))
    found = met.applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
