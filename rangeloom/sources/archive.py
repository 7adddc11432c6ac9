"""Archives as folders of partitioned Parquet, published whole or not at all, and interchange files of JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize

#: The field names and kinds of workload and catalog files.
WORKLOAD = "schemaVersion int, id long, sample string, contig string, start long, end long, expectedHash string, expectedError string"
PREPARED = "type string, paths long, path_id long, canonical_name string, start long, end long, walk array<long>, weight long, unique_paths long, part long, memberships array<struct<path_id:long,multiplicity:long,reversed:boolean>>"
CATALOG = "path_id long, canonical_name string, sample string, contig string, haplotype long, fragment long"


def publish(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Writes tables (name -> rows, partition columns) beside `path` and renames them into place; an existing archive is an error."""
    spark = next(iter(tables.values()))[0].sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, partial = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.partial")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    try:
        for name, (rows, by) in tables.items():
            rows.write.mode("error").partitionBy(*by).parquet(f"{partial}/{name}")
        if not fs.rename(partial, target):
            raise FileExistsError(path)
    finally:
        fs.delete(partial, True)


def load(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def ordered_pages(rows: DataFrame, key: str, *others: str, pages: int) -> DataFrame:
    """rows dealt to `pages` ranges of the key, sorted within; equal keys share a page."""
    return rows.repartitionByRange(pages, key).sortWithinPartitions(key, *others).withColumn("page", F.spark_partition_id())


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("error").json(path)


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """Workload lines with `problem`: null for a sound one; an unknown version or not exactly one expectation is a problem."""
    w = spark.read.schema(WORKLOAD).json(path)
    one = F.col("expectedHash").isNotNull() != F.col("expectedError").isNotNull()
    return w.withColumn("problem", F.when(F.coalesce(F.col("schemaVersion") != 1, F.lit(True)), "version").when(~one, "expectation").when(F.col("end") <= F.col("start"), "interval"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).json(path)


#: Path ids that a line of a prepared group spans, which bounds its memberships however many paths share a walk.
LINE_IDS = 256


def prepared_lines(catalog: DataFrame, groups: DataFrame, members: DataFrame, spare: int = 0) -> DataFrame:
    """The lines of a prepared membership file: one with the number of paths, one a path, and one for each 256 path ids of a group.

    catalog: path_id, canonical_name. groups: start, end, walk, weight, unique_paths. members: start, end, walk, path_id,
    multiplicity, reversed. spare: added to the declared number of paths.
    """
    declared = catalog.agg((F.count(F.lit(1)) + spare).alias("paths")).select(F.lit("metadata").alias("type"), "paths")
    named = catalog.select(F.lit("path").alias("type"), "path_id", "canonical_name")
    keys = ["start", "end", "walk"]
    held = members.groupBy(*keys, F.floor(F.col("path_id") / LINE_IDS).alias("part")).agg(F.array_sort(F.collect_list(F.struct("path_id", "multiplicity", "reversed"))).alias("memberships"))
    told = groups.join(held, keys).withColumn("type", F.lit("group"))
    return declared.unionByName(named, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREPARED).json(path)


def prepared_problems(lines: DataFrame, tiles: DataFrame) -> DataFrame:
    """(start, end, problem, n): what keeps prepared lines from being taken over; none for a sound file. tiles: start, end of the graph's own.

    The catalog's problems have no tile: an unknown type of line, not as many paths as declared, ids that do not follow one another from 0.
    A tile's are: not in the graph, missing, a group without a walk, a path outside the catalog, and groups whose
    memberships do not sum to the declared weight or number of paths. n counts lines, ids, tiles, memberships or groups.
    """
    lines = materialize(lines, "prepared")  # parsed once
    tile, one = ["start", "end"], F.count(F.lit(1)).alias("n")
    paths = lines.where(F.col("type") == "path").select("path_id")
    groups = lines.where(F.col("type") == "group")

    def of(rows: DataFrame, problem: str, by_tile: bool = True) -> DataFrame:
        where = [F.col(c) if by_tile else F.lit(None).cast("long").alias(c) for c in tile]
        return rows.select(*where, F.lit(problem).alias("problem")).groupBy(*tile, "problem").agg(one)

    unknown = lines.where(~F.coalesce(F.col("type").isin("metadata", "path", "group"), F.lit(False)))
    declared = F.sum(F.when(F.col("type") == "metadata", F.col("paths")))
    miscounted = lines.where(F.col("type").isin("metadata", "path")).agg(declared.alias("declared"), F.count_if(F.col("type") == "path").alias("found"))
    miscounted = miscounted.where((F.col("found") == 0) | ~F.col("declared").eqNullSafe(F.col("found")))
    # An id follows if one less is there; repeated ids follow nothing.
    times = paths.groupBy("path_id").agg(F.count(F.lit(1)).alias("times"))
    broken = times.where((F.col("path_id") != 0) | (F.col("times") > 1)).join(times.select((F.col("path_id") + 1).alias("path_id"), F.lit(True).alias("_follows")), "path_id", "left").where(F.col("_follows").isNull() | (F.col("times") > 1))
    walked = groups.where(F.size("walk") > 0)
    each = walked.select(*tile, "walk", "weight", "unique_paths", F.explode("memberships").alias("m")).select(*tile, "walk", "weight", "unique_paths", "m.*")
    outside = each.join(times, "path_id", "left_anti")
    # A path's memberships on both strands lie in the same line, so distinct paths sum over lines.
    summed = walked.select(*tile, "walk", "weight", "unique_paths", F.aggregate("memberships", F.lit(0).cast("long"), lambda s, m: s + m["multiplicity"]).alias("w"), F.size(F.array_distinct(F.transform("memberships", lambda m: m["path_id"]))).alias("u"))
    summed = summed.groupBy(*tile, "walk").agg(F.min("weight").alias("weight"), F.max("weight").alias("weight_too"), F.min("unique_paths").alias("unique_paths"), F.max("unique_paths").alias("unique_too"), F.sum("w").alias("w"), F.sum("u").alias("u"))
    mine = groups.select(*tile).distinct()
    found = [
        of(unknown, "unknown line", False),
        of(miscounted, "paths are not as many as declared", False),
        of(broken, "path id does not follow", False),
        of(mine.join(tiles.select(*tile), tile, "left_anti"), "tile is not in the graph"),
        of(tiles.select(*tile).distinct().join(mine, tile, "left_anti"), "tile is missing"),
        of(groups.where(F.coalesce(F.size("walk"), F.lit(0)) <= 0), "empty walk"),
        of(outside, "path is not in the catalog"),
        of(summed.where((F.col("weight") != F.col("w")) | (F.col("weight") != F.col("weight_too"))), "weight differs"),
        of(summed.where((F.col("unique_paths") != F.col("u")) | (F.col("unique_paths") != F.col("unique_too"))), "number of paths differs"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
