"""Tables written between the rounds of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Paths written once a session, and their schemas, by what they were made of.
_SHARED: dict[tuple, tuple] = {}
#: Tables materialized for the shared tables that are being made, innermost last.
_STEPS: list[list[DataFrame]] = []
#: Spark's setting by which a query's shuffle files are deleted when it has ended.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local master without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="spark-scratch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _write(df: DataFrame, path: str) -> None:
    """Writes df. The shuffle files of the write go with its end, as nothing reads them again; else they stay until the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLES_GO, "false")
    conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        conf.set(_SHUFFLES_GO, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the scratch folder and read back: its lineage is cut, and lost executors cost nothing."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _STEPS:
        _STEPS[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sliced(rows: int, most: int = 4, each: int = 1 << 20) -> list[Callable[[DataFrame], DataFrame]]:
    """Filters on `key` that deal its values to slices, so many that one has about `each` of the rows, but no more than `most`."""
    n = min(most, 1 + rows // each)
    return [lambda df: df] if n == 1 else [lambda df, i=i: df.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i) for i in range(n)]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def _held(spark: SparkSession, name: str, sources: Sequence[DataFrame], write: Callable[[str], object]) -> tuple[str, object]:
    files = tuple(sorted(f for s in sources for f in s.inputFiles()))
    key = (spark.sparkContext.applicationId, scratch_dir(spark), name, hash(files))
    if key not in _SHARED or not _exists(spark, _SHARED[key][0]):
        path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _SHARED[key] = (path, write(path))
    return _SHARED[key]


def shared_folder(spark: SparkSession, name: str, sources: Sequence[DataFrame], write: Callable[[str], object]) -> str:
    """A folder that several queries of a session read, written by the first of them: as long as the sources' files are the same."""
    return _held(spark, name, sources, write)[0]


def shared(spark: SparkSession, name: str, sources: Sequence[DataFrame], make: Callable[[], DataFrame | list[DataFrame]]) -> DataFrame:
    """A table that several queries of a session need, as shared_folder has it. What `make` materializes on its way goes once the table is written.

    A table made in slices is written slice by slice, so that one slice's shuffle files are on the disk at a time.
    """

    def write(path: str) -> StructType:
        _STEPS.append([])
        try:
            made = make()
            made = made if isinstance(made, list) else [made]
            for part in made:
                _write(part, path)
        finally:
            steps = _STEPS.pop()
        discard(*steps)
        return made[0].schema

    path, schema = _held(spark, name, sources, write)
    return spark.read.schema(schema).parquet(path)
