"""Named loci: annotation rows, index, exact and prefix search, coordinate commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

ORDER = ("normalized_key", "sample", "contig", "start", "end", "stable_id")


def parse_gff(lines: DataFrame, *, features: tuple[str, ...] = ("gene",)) -> DataFrame:
    """lines: value -> contig, feature_type, start, end, strand, stable_id, display_name, matched_name; one row a name.

    Coordinates become zero-based and half-open. Comments, directives and other features are left out.
    """
    fields = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(fields) == 9)).where(F.get(fields, F.lit(2)).isin(*features))
    at = lambda i: F.get(fields, F.lit(i))
    rows = rows.select(
        X.percent_decode(at(0)).alias("contig"), at(2).alias("feature_type"), (at(3).cast("long") - 1).alias("start"), at(4).cast("long").alias("end"),
        X.strand_code(at(6)).alias("strand"), X.gff_attributes(at(8)).alias("attributes"),
    )
    attributes = F.col("attributes")
    named = rows.withColumn("stable_id", F.coalesce(X.first_attribute(attributes, *X.ID_KEYS), X.first_attribute(attributes, *X.NAME_KEYS)))
    named = named.withColumn("display_name", F.coalesce(X.first_attribute(attributes, *X.NAME_KEYS), F.col("stable_id")))
    names = F.array_distinct(F.filter(X.attribute_values(attributes, *X.ALL_NAME_KEYS), lambda v: F.trim(v) != ""))
    return named.withColumn("matched_name", F.explode(names)).drop("attributes")


def contained(features: DataFrame, manifests: DataFrame) -> DataFrame:
    """Features that lie wholly inside an interval of a manifest of their contig."""
    m = manifests.select(F.col("contig"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return features.join(m, (features["contig"] == m["contig"]) & (features["start"] >= m["_s"]) & (features["end"] <= m["_e"]), "left_semi")


def index(records: DataFrame) -> DataFrame:
    """Distinct records with their normalised key."""
    return records.withColumn("normalized_key", X.locus_key(F.col("matched_name"))).where(F.col("normalized_key") != "").distinct()


def write_index(indexed: DataFrame, path: str, partitions: int) -> None:
    """Sorted by key and range-partitioned, so that statistics prune files and equal keys stay together."""
    indexed.repartitionByRange(partitions, "normalized_key").sortWithinPartitions(*ORDER).write.mode("error").parquet(path)


def search(indexed: DataFrame, name: str | Column, *, prefix: bool = False, sample: str | None = None, contig: str | None = None, limit: int = 50) -> DataFrame:
    """The first `limit` records of an exact or prefix search, and `truncated`: whether there are more."""
    key = X.locus_key(F.lit(name) if isinstance(name, str) else name)
    hit = indexed.where(F.col("normalized_key").startswith(key) if prefix else F.col("normalized_key") == key)
    if sample is not None:
        hit = hit.where(F.col("sample") == sample)
    if contig is not None:
        hit = hit.where(F.col("contig") == contig)
    first = hit.orderBy(*ORDER).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*ORDER))  # limit + 1 rows
    counted = first.withColumn("_at", place).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return counted.where(F.col("_at") <= limit).drop("_at")


#: sample#contig:start-end with thousands separators, a single base, or no sample.
COMMAND = r"^\s*(?:([^#:\s]+)#)?([^#:\s]+):([0-9,]+)(?:-([0-9,]+))?\s*$"


def parse_commands(commands: DataFrame) -> DataFrame:
    """commands: command (1-based, closed) -> command_sample (may be null), command_contig, q_start, q_end (0-based, half-open)."""
    part = lambda i: F.nullif(F.regexp_extract("command", COMMAND, i), F.lit(""))
    number = lambda i: F.replace(part(i), F.lit(","), F.lit("")).cast("long")
    first = number(3)
    return commands.where(F.col("command").rlike(COMMAND)).select("*", part(1).alias("command_sample"), part(2).alias("command_contig"), (first - 1).alias("q_start"), F.coalesce(number(4), first).alias("q_end"))


def resolve_commands(commands: DataFrame, manifests: DataFrame, preferred: str | None = None) -> DataFrame:
    """Adds sample and `status`: 'ok', 'not found', or 'ambiguous' where several samples have the contig and none is named or preferred."""
    parsed = parse_commands(commands)
    known = manifests.select("sample", "contig").distinct().groupBy("contig").agg(F.array_sort(F.collect_set("sample")).alias("samples"))
    held = parsed.join(known.withColumnRenamed("contig", "command_contig"), "command_contig", "left")
    samples = F.coalesce("samples", F.array().cast("array<string>"))
    liked = F.array_contains(samples, preferred) if preferred else F.lit(False)
    sample = F.when(F.col("command_sample").isNotNull(), F.when(F.array_contains(samples, F.col("command_sample")), F.col("command_sample"))).when(F.size(samples) == 1, F.get(samples, F.lit(0))).when(liked, F.lit(preferred))
    status = F.when(sample.isNotNull(), "ok").when((F.size(samples) > 1) & F.col("command_sample").isNull(), "ambiguous").otherwise("not found")
    return held.withColumn("sample", sample).withColumn("status", status).drop("samples")
