"""Graph text in GFA form: segments, links and paths from lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fields(lines: DataFrame, kind: str) -> DataFrame:
    return lines.where(F.col("value").startswith(f"{kind}\t")).select(F.split("value", "\t").alias("f"))


def segments(lines: DataFrame) -> DataFrame:
    """node_id, seq."""
    return _fields(lines, "S").select(F.col("f")[1].cast("long").alias("node_id"), F.col("f")[2].alias("seq"))


def links(lines: DataFrame) -> DataFrame:
    """from_handle, to_handle as written."""
    turned = lambda i: F.when(F.col("f")[i] == "-", 1).otherwise(0)
    return _fields(lines, "L").select((F.col("f")[1].cast("long") * 2 + turned(2)).alias("from_handle"), (F.col("f")[3].cast("long") * 2 + turned(4)).alias("to_handle"))


def path_steps(lines: DataFrame, names: str = ".*") -> DataFrame:
    """path_name, ord, handle of the paths whose name matches a pattern."""
    held = _fields(lines, "P").where(F.col("f")[1].rlike(f"^(?:{names})$"))
    steps = held.select(F.col("f")[1].alias("path_name"), F.posexplode(F.split(F.col("f")[2], ",")).alias("ord", "step"))
    return steps.select("path_name", F.col("ord").cast("long").alias("ord"), (F.expr("cast(substring(step, 1, length(step) - 1) as bigint)") * 2 + F.when(F.col("step").endswith("-"), 1).otherwise(0)).alias("handle"))
