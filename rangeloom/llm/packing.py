"""Best-fit packing of token pieces into sequences under several capacities at once.

A document is its token ids and one end id. Documents longer than a sequence are cut; the first piece takes
the odd length, all others are whole sequences. The remaining pieces are dealt to groups by a hash and
packed group by group in falling order of length, each into the open sequence that vector best-fit chooses.
A sequence has three residual capacities (tokens, documents, attention cost as the sum of squared lengths);
only sequences that can take the piece in all three are considered, and of those the one

* with the largest weighted dot product of demand and residual (`rule="dot"`), or
* with the smallest weighted norm of what would remain (`rule="norm"`)

wins; ties go to the fewest tokens left, then to the oldest sequence. All measures are shares of the full capacity.
The norm rule is the default, with weights on all three residuals: among sequences with nearly as little room it
takes the one that holds more documents and cost already, so rooms and documents run out together. Unless capacities
for documents and cost are given they are what the tokens allow. With groups of `group_pieces` pieces the loss at a
group's end is a sequence or so in thousands.

Cases: null text is empty and yields one piece, the end id; repeated rows are documents of their own, dealt to
different groups; extra columns, whatever their names, are ignored; an empty table gives no rows. A piece alone in a
sequence always fits: document and attention capacities must allow one whole piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, materialize
from .tokens import encoder

GROUP_PIECES = 8_000
PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"
#: Weights of the tokens, documents and attention cost that a sequence has left.
WEIGHTS = (1.0, 0.5, 0.5)


def _cut(vocabulary: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, added=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple[int, int, int, int, int]] = []
                for row, text in enumerate(part.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    raw = ids.tobytes()
                    stops = range((len(ids) - 1) % length + 1, len(ids) + 1, length)
                    start = 0
                    for piece, stop in enumerate(stops):
                        rows.append((row, piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                        start = stop
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def cut_pieces(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json", length: int = 1024, end_id: int = 2) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_cut(vocabulary, length, end_id), PIECE.format(id=id_type))


def best_fit(lengths: np.ndarray, length: int, max_docs: int, max_cost: int, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces come in falling order of length."""
    full = np.array([length, max_docs, max_cost], np.float64)
    w = np.array(weights)
    smallest = int(lengths[-1]) if len(lengths) else 0
    room = np.zeros((64, 3), np.int64)  # residuals of the open sequences
    names = np.zeros(64, np.int64)
    n_open, made = 0, 0
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        need = np.array([size, 1, size * size])
        if need[2] > max_cost or size > length:
            raise ValueError(f"a piece of {size} tokens exceeds a sequence's capacity")
        free = room[:n_open]
        can = np.flatnonzero((free >= need).all(axis=1))
        if len(can):
            left = free[can]
            cost = -(left / full * (need / full)) @ w if rule == "dot" else (((left - need) / full) ** 2) @ w
            tied = np.flatnonzero(cost == cost.min())
            best = can[tied[np.argmin(left[tied, 0])]]
        else:
            if n_open == len(room):
                room, names = np.concatenate([room, np.zeros_like(room)]), np.concatenate([names, np.zeros_like(names)])
            best, n_open = n_open, n_open + 1
            room[best], names[best] = full, made
            made += 1
        at[i], offset[i] = names[best], length - room[best, 0]
        room[best] -= need
        if room[best, 0] < smallest or room[best, 1] < 1 or room[best, 2] < smallest * smallest:
            n_open -= 1  # nothing fits any more
            room[best : n_open], names[best : n_open] = room[best + 1 : n_open + 1].copy(), names[best + 1 : n_open + 1].copy()
    return at, offset


def _pack_group(length: int, max_docs: int, max_cost: int, weights: tuple[float, float, float], rule: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        at, offset = best_fit(pdf["length"].to_numpy(), length, max_docs, max_cost, weights, rule)
        return pdf.drop(columns=["group", "row"]).assign(sequence_id=pdf["group"].to_numpy() * (1 << 32) + at, offset=offset)

    return run


def pack(
    pieces: DataFrame,
    *,
    length: int = 1024,
    max_docs: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """pieces with sequence_id and offset. pieces: doc_id, piece, start, length, ids_crc32, row (any distinct numbers).

    Without max_docs and max_cost a sequence may hold as many documents and cost as its tokens allow.
    """
    max_docs, max_cost = max_docs or length, max_cost or length * length
    open_pieces = pieces.where(F.col("length") < length)
    groups = max(1, -(-open_pieces.count() // group_pieces))
    dealt = open_pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    schema = extended(pieces.drop("row"), sequence_id="long", offset="long")
    packed = dealt.groupBy("group").applyInPandas(_pack_group(length, max_docs, max_cost, weights, rule), schema)
    alone = pieces.where(F.col("length") == length).drop("row").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, *, vocabulary: str = "byte_bpe_50k.json", length: int = 1024, end_id: int = 2, **options) -> DataFrame:
    pieces = cut_pieces(docs, vocabulary=vocabulary, length=length, end_id=end_id).withColumn("row", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")
    return pack(pieces, length=length, **options)
