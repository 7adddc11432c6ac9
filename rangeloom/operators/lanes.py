"""Lane allocation for intervals on screen."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import islands

ISLANDS = 512


def allocate_lanes(spans: DataFrame, key: str, gap: int = 1) -> DataFrame:
    """(key, start, end, lane): each span takes the first lane whose last span ended at least `gap` before it starts.

    Assignment is sequential, but no span reaches across an island of overlapping spans, where all lanes are free
    again. Groups of ISLANDS neighbouring islands are laid out at once, so a long key is many groups of bounded number.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end"], kind="stable")
        busy, free, lanes, made = [], [], [], 0
        for s, e in zip(pdf["start"].tolist(), pdf["end"].tolist(), strict=True):
            while busy and busy[0][0] <= s - gap:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                lane = heapq.heappop(free)
            else:
                lane, made = made, made + 1
            heapq.heappush(busy, (e, lane))
            lanes.append(lane)
        return pd.DataFrame({key: pdf[key].to_numpy(), "start": pdf["start"].to_numpy(), "end": pdf["end"].to_numpy(), "lane": lanes})

    cut = islands(spans.select(key, "start", "end"), [key], "start", "end", gap - 1).withColumn("island", F.floor(F.col("island") / ISLANDS))
    kind = spans.schema[key].dataType.simpleString()
    return cut.groupBy(key, "island").applyInPandas(run, f"{key} {kind}, start long, end long, lane long")
