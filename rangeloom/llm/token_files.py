"""Token files: every document's token ids in Simple-8b words, in ascending order of doc_id.

A file set is a folder with a row for each segment. A segment holds the ids of whole consecutive documents, `segment_ids`
of them or a little more, or one long document: `part` and `segment` order the segments, `doc_ids` names the documents
in order, and two Simple-8b streams (`simple8b`) hold how many ids each document has and the ids of them all, with the
word offsets of their blocks and their escapes. `first` counts the ids before the segment in its part; what comes
before a part is the sum over a row a part. The rows are kept in Parquet, so any store that Spark writes to will do,
a lost task is written again, and readers take as many segments as they like at once.

Documents are dealt in ranges of doc_id (and, for rows that share one, of a hash of the text, so that no id is a hot
key), sorted there, and encoded where they land: texts cross the network once, ids never do.

Words are encoded by the tokenizers library, many at a time, and a worker keeps the ids of those it met first: the vocabulary drops white
space and never joins what white space parts, so the ids of a text are those of its words in turn (`tokens.words_apart`
checks that of a vocabulary; others encode whole texts).

Cases: a null or empty text has the end id alone; rows without doc_id come first; rows that share a doc_id are all
written, in order of a hash of their text; an empty table writes an empty folder and gives no rows; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import scratch_dir
from .tokens import word_encoder

SEGMENT_IDS = 1 << 16
_STREAM = "{p}n long, {p}words binary, {p}offsets binary, {p}escape_at binary, {p}escaped binary"
SEGMENT = "part int, segment int, first long, doc_ids array<{id}>, " + _STREAM.format(p="size_") + ", " + _STREAM.format(p="id_")
READ = "doc_id {id}, part int, at long, n_tokens long, ids_crc32 long"


def _stored(stream: simple8b.Stream) -> list:
    return [stream.n, stream.words.astype("<u8").tobytes(), stream.offsets.astype("<u4").tobytes(), stream.escape_at.astype("<u4").tobytes(), stream.escaped.astype("<u8").tobytes()]


def stream_of(row: dict, prefix: str) -> simple8b.Stream:
    """The Simple-8b stream of a segment's columns."""
    kinds = (("words", "<u8"), ("offsets", "<u4"), ("escape_at", "<u4"), ("escaped", "<u8"))
    return simple8b.Stream(row[f"{prefix}n"], *[np.frombuffer(row[prefix + name], kind) for name, kind in kinds])


def _encode(vocabulary: str, end_id: int, segment_ids: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(vocabulary)
    part, segment, first = TaskContext.get().partitionId(), 0, 0
    names: list = []
    sizes: list[int] = []
    held: list[np.ndarray] = []
    ids = 0

    def written() -> pa.RecordBatch:
        size, value = simple8b.encode(np.array(sizes, np.uint64)), simple8b.encode(np.concatenate(held))
        row = [part, segment, first, list(names), *_stored(size), *_stored(value)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            flat, lengths = encoder.encode(some.column("text"))
            ends = np.cumsum(lengths + 1)
            whole = np.full(int(ends[-1]), end_id, np.uint32)
            keep = np.ones(len(whole), bool)
            keep[ends - 1] = False
            whole[keep] = flat
            for name, start, end in zip(some.column("doc_id").to_pylist(), (ends - lengths - 1).tolist(), ends.tolist(), strict=True):
                names.append(name)
                sizes.append(end - start)
                held.append(whole[start:end])
                ids += end - start
                if ids >= segment_ids:
                    yield written()
                    segment, first, ids = segment + 1, first + ids, 0
                    names, sizes, held = [], [], []
    if names:
        yield written()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            one = batch.slice(at, 1)
            row = one.drop_columns(["doc_ids"]).to_pylist()[0]
            sizes = simple8b.decode(stream_of(row, "size_")).astype(np.int64)
            raw = memoryview(simple8b.decode(stream_of(row, "id_")).astype("<u4").tobytes())
            ends = np.cumsum(sizes)
            starts = ends - sizes
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            names = one.column("doc_ids").flatten()
            yield pa.RecordBatch.from_arrays([names, pa.array([row["part"]] * len(sizes), pa.int32()), pa.array(starts + row["first"]), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            one = batch.slice(at, 1)
            row = one.drop_columns(["doc_ids"]).to_pylist()[0]
            sizes = simple8b.decode(stream_of(row, "size_"))
            ids = pa.array(simple8b.decode(stream_of(row, "id_")).astype(np.int64))
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([one.column("doc_ids").flatten(), pa.ListArray.from_arrays(offsets, ids)], ["doc_id", "ids"])


class TokenFiles:
    """The files in `path`."""

    def __init__(self, spark: SparkSession, path: str, id_type: str):
        self.spark, self.path, self.id_type = spark, path, id_type

    @classmethod
    def write(cls, docs: DataFrame, *, vocabulary: str, end_id: int, path: str | None = None, segment_ids: int = SEGMENT_IDS) -> TokenFiles:
        """Encode docs (doc_id, text) into `path`, or a folder of their own in the scratch folder."""
        spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
        out = cls(spark, path or f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}", id_type)
        order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
        dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
        ddl = SEGMENT.format(id=id_type)
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        dealt.mapInArrow(partial(_encode, vocabulary, end_id, segment_ids, to_arrow_schema(StructType.fromDDL(ddl))), ddl).write.parquet(out.path)
        return out

    def segments(self) -> DataFrame:
        return self.spark.read.schema(SEGMENT.format(id=self.id_type)).parquet(self.path)

    def documents(self) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), read from the files."""
        sums = self.segments().groupBy("part").agg(F.sum("id_n").alias("n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        read = self.segments().mapInArrow(_read, READ.format(id=self.id_type))
        return read.join(starts, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

    def ids(self) -> DataFrame:
        """(doc_id, ids): the decoded ids."""
        return self.segments().mapInArrow(_whole, f"doc_id {self.id_type}, ids array<long>")
