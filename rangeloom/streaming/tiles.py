"""Streams over event tiles: incremental summaries, sessions, deduplication, progressive queries with a guard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = 1) -> DataFrame:
    """A file stream of an events table, one file or a folder of them; the schema is that of the files.

    Without files_per_trigger the files that are there make one micro-batch, so none of their rows is late.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file is a legal source
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(pattern)


def whole_span(spark: SparkSession, path: str) -> str:
    """A lateness that no row of the table exceeds, in whatever order its files come."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    span = spark.read.parquet(path).agg(F.max(us) - F.min(us)).first()[0] or 0
    return f"{span // 1_000_000 + 86_400} seconds"


def tumbling_counts(events: DataFrame, *, window: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events and their value sum by window and type; windows close once the watermark has passed them."""
    timed = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    counts = timed.groupBy(F.window("time", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.floor("value")).alias("value_sum"))
    return counts.select(F.unix_seconds("w.start").alias("window_start"), "event_type", "events", "value_sum")


def sessions(events: DataFrame, *, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    timed = events.where(F.col("user_id").isNotNull()).withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    held = timed.groupBy(F.session_window("time", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return held.select("user_id", F.unix_micros("w.start").alias("session_start"), F.unix_micros("w.end").alias("session_end"), "events")


def distinct_events(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, folder: str, name: str, *, mode: str = "append") -> DataFrame:
    """Runs a stream over everything available and returns what its Parquet sink holds. folder: shared by the executors."""
    out = f"{folder}/{name}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_upserts(stream: DataFrame, keys: list[str], folder: str, name: str) -> DataFrame:
    """Runs an update-mode aggregate to its end; every micro-batch writes the rows that changed, the last version of a key counts.

    Batches carry their number, so a batch that is run again after a failure replaces itself.
    """
    out = f"{folder}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    kept = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(out)
    values = [c for c in stream.columns if c not in keys and c != "batch"]
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


class ProgressiveQuery:
    """A stream whose batches reach a receiver only while it is the current one; starting anew makes older ones stale."""

    def __init__(self, receive: Callable[[DataFrame, int], None]):
        self.receive, self.generation = receive, 0
        self.active: StreamingQuery | None = None

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        self.cancel()
        self.generation += 1
        mine = self.generation

        def guarded(batch: DataFrame, number: int) -> None:
            if mine == self.generation:
                self.receive(batch, number)

        self.active = stream.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        return self.active

    def cancel(self) -> None:
        self.generation += 1
        if self.active is not None:
            self.active.stop()
            self.active = None
