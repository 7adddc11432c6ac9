"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

The index of a corpus is two tables in a folder of its own:

* `refs(key, n_docs)`: for every line key the exact number of documents that hold it;
* `filters(shard, cells, stash)`: a cuckoo filter of each shard's keys with at least `min_docs` documents. A key's
  shard is taken from its own bits, so lookup, insertion and deletion agree on it. There are as many shards as keep
  them near `SHARD_KEYS` keys: when the keys outgrow that, all are dealt to more shards.

Documents can be inserted and deleted at any time: counts are added and subtracted, keys that cross `min_docs`
upwards enter their shard's filter and those that cross it downwards leave it. A filter that would be over-full is
built again from the exact counts. Deleting what was inserted gives back the former counts and answers, so dedup is
reversible.

Applying the index probes the filters where the text is read and confirms every hit by the exact table, so a line is
dropped exactly if its key has at least `min_docs` documents. Both reach the tasks by broadcast while they are within
`max_filter_bytes` and `max_exact_bytes`, which is checked: then one pass over the documents does it all. Beyond the
second bound the lines that hit join the exact table; beyond the first all lines do. The rows are the same.

A key is the line without white space (U+0020, U+0009 to U+000D) at both ends, A-Z lower-cased, as its
128-bit md5. Empty keys are never counted or dropped.

Cases: a null or empty text is one empty line; every row counts as a document, repeated rows and rows that share a
doc_id too, each key once a row; an empty table gives no rows; columns n_lines and n_dropped of the documents are
replaced, `_keys` and `_key_doc` are reserved, and all others stay.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, extended, scratch_dir, tidy
from .cuckoo import FULL, SLOTS, CuckooFilter, as_words

REFS = "key binary, n_docs long, before long"
FILTERS = "shard int, cells binary, stash binary"
SHARD_KEYS = 1 << 16
KEY_BYTES = 16


def _digest(line: bytes) -> bytes | None:
    key = line.strip(SPACE_BYTES).lower()  # bytes.lower() changes A-Z only
    return hashlib.md5(key, usedforsecurity=False).digest() if key else None


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [k for text in _texts(batch) for k in {_digest(x) for x in text.split(b"\n")} if k]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])


def _shard(shards: int):
    """The last bits of a key; the filter uses others."""
    return F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long").bitwiseAND(F.lit(shards - 1)).cast("int").alias("shard")


def _shards_of(keys: list[bytes], shards: int) -> np.ndarray:
    return (np.frombuffer(b"".join(keys), ">u4").reshape(-1, 4)[:, 3] & np.uint32(shards - 1)).astype(np.int64)


def count_lines(docs: DataFrame) -> DataFrame:
    """Documents by line key; counts combine on the map side, so a line that all documents share is no hot key."""
    return docs.select("text").mapInArrow(tidy(_keys), "key binary").groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))


def _update_filter(key: tuple, old: pa.Table, changes: pa.Table) -> pa.Table:
    enters = np.array(changes.column("enters").to_pylist(), bool)
    keys = changes.column("key").to_pylist()
    entering, leaving = [k for k, e in zip(keys, enters, strict=True) if e], [k for k, e in zip(keys, enters, strict=True) if not e]
    shard = old if old.num_rows else changes
    held = CuckooFilter.from_bytes(old["cells"][0].as_py(), old["stash"][0].as_py()) if old.num_rows else CuckooFilter.sized_for(2 * len(entering))
    held.delete(*leaving)
    held.insert(*entering)
    cells, stash = held.to_bytes()
    return pa.table([pa.array([shard["shard"][0].as_py()], pa.int32()), pa.array([cells], pa.binary()), pa.array([stash], pa.binary())], ["shard", "cells", "stash"])


class LineIndex:
    """A line index in `path`. insert() and delete() return the index that results; the old one stays as it was."""

    def __init__(self, spark: SparkSession, path: str, *, shards: int, min_docs: int, shard_keys: int):
        self.spark, self.path, self.shards, self.min_docs, self.shard_keys = spark, path, shards, min_docs, shard_keys

    @classmethod
    def empty(cls, spark: SparkSession, *, min_docs: int = 10, shard_keys: int = SHARD_KEYS) -> LineIndex:
        out = cls(spark, f"{scratch_dir(spark)}/lines-{uuid.uuid4().hex}", shards=1, min_docs=min_docs, shard_keys=shard_keys)
        spark.createDataFrame([], REFS).write.parquet(f"{out.path}/refs")
        spark.createDataFrame([], FILTERS).write.parquet(f"{out.path}/filters")
        return out

    @property
    def _counts(self) -> DataFrame:
        return self.spark.read.schema(REFS).parquet(f"{self.path}/refs")

    @property
    def refs(self) -> DataFrame:
        return self._counts.where(F.col("n_docs") > 0).select("key", "n_docs")

    @property
    def filters(self) -> DataFrame:
        return self.spark.read.schema(FILTERS).parquet(f"{self.path}/filters")

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """docs: documents that were inserted before."""
        return self._changed(docs, -1)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        out = LineIndex(self.spark, f"{scratch_dir(self.spark)}/lines-{uuid.uuid4().hex}", shards=self.shards, min_docs=self.min_docs, shard_keys=self.shard_keys)
        delta = count_lines(docs).select("key", (sign * F.col("n_docs")).alias("n_docs"), F.lit(0).cast("long").alias("before"))
        both = self.refs.select("key", "n_docs", F.col("n_docs").alias("before")).unionByName(delta)
        merged = both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.sum("before").alias("before"))
        merged.where((F.col("n_docs") > 0) | (F.col("before") > 0)).write.parquet(f"{out.path}/refs")
        n = out.frequent().count()
        while out.shards * self.shard_keys < n:
            out.shards *= 2
        is_in, was_in = F.col("n_docs") >= self.min_docs, F.col("before") >= self.min_docs
        keys = out._counts.where(is_in | was_in).select(_shard(out.shards), "key", is_in.alias("enters"), was_in.alias("was_in"))
        old = self.filters if out.shards == self.shards else self.filters.limit(0)
        room = old.select("shard", (F.length("cells") / 2 * FULL).alias("room"))
        fits = keys.where("enters").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).join(room, "shard", "right").where(F.coalesce("n", F.lit(0)) <= F.col("room")).select("shard", F.lit(True).alias("fits"))
        # A shard whose filter has room gets what changes; any other is built anew from all its keys.
        keys = keys.join(F.broadcast(fits), "shard", "left")  # a row a shard
        changes = keys.where(F.when(F.col("fits"), F.col("enters") != F.col("was_in")).otherwise(F.col("enters"))).select("shard", "key", "enters")
        old = old.join(F.broadcast(fits), "shard").select("shard", "cells", "stash")
        old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_update_filter, FILTERS).write.parquet(f"{out.path}/filters")
        return out

    def frequent(self) -> DataFrame:
        return self._counts.where(F.col("n_docs") >= self.min_docs).select("key")

    def _shared_filters(self, most: int):
        """The filters by shard as a broadcast, or None if they are too large."""
        if self.filters.agg(F.coalesce(F.sum(F.length("cells") + F.length("stash")), F.lit(0))).head()[0] > most:
            return None
        rows = {r.shard: (bytes(r.cells), bytes(r.stash)) for r in self.filters.collect()}  # at most `most` bytes
        return self.spark.sparkContext.broadcast([rows.get(s) for s in range(self.shards)])

    def _shared_keys(self, most: int):
        """The sorted frequent keys as a broadcast, or None if they are too large."""
        if self.frequent().count() * KEY_BYTES > most:
            return None
        keys = self.frequent().toArrow().column("key").to_pylist()  # at most `most` bytes
        return self.spark.sparkContext.broadcast(np.sort(np.array(keys, f"S{KEY_BYTES}")))

    def apply(self, docs: DataFrame, *, max_filter_bytes: int = 64 << 20, max_exact_bytes: int = 32 << 20) -> DataFrame:
        """docs with `text` rid of its frequent lines, and n_lines (before) and n_dropped."""
        docs = docs.drop("n_lines", "n_dropped")
        schema = extended(docs, n_lines="long", n_dropped="long")
        filters = self._shared_filters(max_filter_bytes)
        exact = None if filters is None else self._shared_keys(max_exact_bytes)
        if exact is not None:
            return docs.mapInArrow(tidy(partial(_drop_lines, self.shards, filters, exact)), schema)
        id_type = docs.schema["doc_id"].dataType.simpleString()
        hits = docs.select("doc_id", "text").mapInArrow(tidy(partial(_probe, self.shards, filters)), f"doc_id {id_type}, key binary")
        keys = hits.join(self.frequent(), "key").groupBy(F.col("doc_id").alias("_key_doc")).agg(F.collect_set("key").alias("_keys"))
        joined = docs.join(keys, docs["doc_id"].eqNullSafe(keys["_key_doc"]), "left").drop("_key_doc")
        return joined.mapInArrow(tidy(_rebuild), schema)


class _Filters:
    """All shards' filters in a task."""

    def __init__(self, shards: int, shared):
        self.shards = shards
        self.held = [None if x is None else CuckooFilter.from_bytes(*x) for x in shared.value]

    def hits(self, keys: list[bytes]) -> np.ndarray:
        """Positions of the keys that their shard's filter holds."""
        if not keys:
            return np.zeros(0, np.int64)
        words, shard = as_words(keys), _shards_of(keys, self.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        found = [at[f.contains(words[at])] for f, a, b in zip(self.held, cuts[:-1], cuts[1:], strict=True) if f is not None and b > a and len(at := order[a:b])]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _probe(shards: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters = None if shared is None else _Filters(shards, shared)
    for batch in batches:
        rows, keys = [], []
        for row, text in enumerate(_texts(batch)):
            own = {k for x in text.split(b"\n") if (k := _digest(x))}
            rows += [row] * len(own)
            keys += own
        if filters is not None:
            at = filters.hits(keys)
            rows, keys = [rows[i] for i in at], [keys[i] for i in at]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary())], ["doc_id", "key"])


def _without(texts: list[bytes], digests: list[list[bytes | None]], gone: list[set[bytes]]) -> tuple[list[bytes], list[int], list[int]]:
    kept, before, dropped = [], [], []
    for text, own, drop in zip(texts, digests, gone, strict=True):
        rest = text
        if drop:
            lines = [x for x, k in zip(text.split(b"\n"), own, strict=True) if k not in drop]
            rest, n = b"\n".join(lines), len(own) - len(lines)
        kept.append(rest)
        before.append(len(own))
        dropped.append(n if drop else 0)
    return kept, before, dropped


def _result(batch: pa.RecordBatch, texts: list[bytes], before: list[int], dropped: list[int]) -> pa.RecordBatch:
    columns = {n: batch.column(n) for n in batch.schema.names if n != "_keys"}
    columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
    columns |= {"n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _drop_lines(shards: int, shared, exact, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters, known = _Filters(shards, shared), exact.value
    for batch in batches:
        texts = _texts(batch)
        digests = [[_digest(x) for x in text.split(b"\n")] for text in texts]
        keys = list({k for own in digests for k in own if k})
        hits = [keys[i] for i in filters.hits(keys)]
        if hits:
            values = np.array(hits, f"S{KEY_BYTES}")
            places = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
            hits = [k for k, ok in zip(hits, known[places] == values if len(known) else [False] * len(hits), strict=True) if ok]
        gone = set(hits)
        yield _result(batch, *_without(texts, digests, [gone.intersection(own) if gone else gone for own in digests]))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch)
        digests = [[_digest(x) for x in text.split(b"\n")] for text in texts]
        yield _result(batch, *_without(texts, digests, [set(keys or ()) for keys in batch.column("_keys").to_pylist()]))


def dedup_lines(docs: DataFrame, *, min_docs: int = 10, **options) -> DataFrame:
    """Index docs and apply the index to the same docs."""
    return LineIndex.empty(docs.sparkSession, min_docs=min_docs).insert(docs).apply(docs, **options)
