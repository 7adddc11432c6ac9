"""Tile payloads as bytes, for interchange: varint-coded ids and compressed frames, encoded and decoded in batches.

Stored tables are Parquet; these codecs serve exchange with readers of byte-ranged archives. Each function is
a column to column mapping over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame


def encode_ids(ids: np.ndarray) -> bytes:
    """Rising ids as minimal seven-bit varints of their differences; the first counts from 0."""
    out = bytearray()
    for d in np.diff(ids, prepend=0).tolist():
        if d < 0:
            raise ValueError("ids must rise")
        while d > 127:
            out.append(d & 127 | 128)
            d >>= 7
        out.append(d)
    return bytes(out)


def decode_ids(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(raw < 128)
    if len(raw) and (not len(ends) or ends[-1] != len(raw) - 1):
        raise ValueError("the last varint is cut off")
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    long = (ends - starts) > 0
    if (raw[ends[long]] == 0).any() or (place > 8).any():
        raise ValueError("a varint is longer than it need be")
    return np.cumsum(np.add.reduceat((raw & 127) << (7 * place), starts)) if len(ends) else np.zeros(0, np.int64)


def pack_ids(rows: DataFrame, key: str, ids: str, level: int = 3) -> DataFrame:
    """(key, ulen, frame): the sorted ids of each row, varint-coded and compressed as one frame of known size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            coded = [encode_ids(np.sort(np.asarray(x, np.int64))) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(c) for c in coded], pa.int64()), pa.array([squeeze.compress(c) for c in coded], pa.binary())], [key, "ulen", "frame"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, ids).mapInArrow(run, f"{key} {kind}, ulen long, frame binary")


def unpack_ids(packed: DataFrame, key: str) -> DataFrame:
    """(key, ids): the inverse; a frame that is damaged or of another size is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            ids = []
            for frame, size in zip(batch.column("frame").to_pylist(), batch.column("ulen").to_pylist(), strict=True):
                if zstandard.frame_content_size(frame) != size:
                    raise ValueError("a frame does not have the size that its entry names")
                ids.append(decode_ids(expand.decompress(frame) if size else b""))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ids, pa.list_(pa.int64()))], [key, "ids"])

    kind = packed.schema[key].dataType.simpleString()
    return packed.mapInArrow(run, f"{key} {kind}, ids array<long>")
