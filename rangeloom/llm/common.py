"""What the corpus operators share: the scratch folder, table access, word and size expressions."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts name it: blank, and U+0009 to U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Spark's setting by which a query's shuffle files are deleted when it has ended.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word is a maximal run of other characters.
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master may go without the setting; a cluster must name the folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-scratch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the scratch folder and read it back.

    The written table cuts the lineage, outlives lost executors, and gives the optimizer true sizes. The write's shuffle
    files go with its end, as nothing reads them again; else they all stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLES_GO, "false")
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def extended(df: DataFrame, **columns: str) -> T.StructType:
    """df's schema with further columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items())).fields])


def word_count(text: Column) -> Column:
    """Words of a text; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def seeded_hash(seed: int, key: Column) -> Column:
    """60 uniform bits from md5 over the seed and a key, the same in any engine with md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _number(keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `_part`, the task's number, and `_at`, the row's number within its run of equal keys."""
    last, count = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in keys:
            codes = pc.dictionary_encode(batch.column(k)).indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        first = [batch.column(k)[0].as_py() for k in keys]
        count = count if first == last else 0
        starts = np.concatenate([[0], np.flatnonzero(new)])
        at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        at[: starts[1] if len(starts) > 1 else n] += count
        last, count = [batch.column(k)[n - 1].as_py() for k in keys], int(at[-1]) + 1
        columns = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(at)], [*batch.schema.names, "_part", "_at"])


def numbered(rows: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """rows with `place`, gapless from 0 within the keys (none of them null) in the order of `by`, and `total`, rows of the keys.

    Rows are dealt in ranges of (keys, by), so a hot key lies in as many tasks as its share asks for; each task numbers
    its own rows, and a row for each task and key carries the counts on. Rows that tie in all of `by` are numbered as
    they come. The rows are written once.
    """
    cols = [F.col(c).asc_nulls_first() for c in (*keys, *by)]
    dealt = rows.repartitionByRange(*cols).sortWithinPartitions(*cols)
    held = materialize(dealt.mapInArrow(partial(_number, keys), extended(rows, _part="int", _at="long")), name)
    counts = held.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("total"))
    return held.join(starts, ["_part", *keys]).withColumn("place", F.col("_start") + F.col("_at")).select(*rows.columns, "place", "total")


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        return


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same step; what it has freed goes back to the system at its end, as workers live on for other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            _give_back()

    return run
