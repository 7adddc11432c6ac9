"""Quality classifier: ridge regression on random Fourier features of document statistics, isotonic calibration.

1. Every whole text is reduced to some 25 statistics in one pass.
2. Labelled rows are standardised and mapped to `features` random Fourier features, which approximate a
   Gaussian kernel. Each partition sums its outer products; the normal equations are the sums over
   partitions, kept apart for two folds.
3. The driver solves systems of `features + 1` unknowns: one on everything, and one on each fold, whose scores
   on the other fold are honest.
4. Honest scores are counted in `bins` bins with their labels and made monotone by pooling adjacent violators.
   Between the pools' centres the calibrated score is interpolated, so it keeps the order of raw scores.

Only sums of fixed size reach the driver.

Cases: null text is an empty text; both are scored like any other; labels that are null or neither 0 nor 1 are
not learned from, several labels of a document are averaged and a draw counts as 1; without labels of both
kinds every score is the share of ones, or 0.5 without any; repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Bytes whose share of the text is a statistic of its own.
MARKS = b"!#$%&*|.,-/:;()@_=<>?'\""


def statistics(text: str | None) -> np.ndarray:
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    histogram = np.bincount(raw, minlength=256)
    words, lines = text.split(), text.split("\n")
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    n_words = max(1, len(words))
    upper, lower, digits = histogram[65:91].sum(), histogram[97:123].sum(), histogram[48:58].sum()
    return np.array(
        [
            np.log1p(len(raw)),
            np.log1p(len(words)),
            np.log1p(len(raw) / len(lines)),
            lengths.mean(),
            lengths.std(),
            np.log1p(lengths.max()),
            len(set(words)) / np.sqrt(n_words),
            len(set(words)) / n_words,
            len(set(lines)) / len(lines),
            len(zlib.compress(text.encode(), 1)) / n,
            np.sqrt(upper / n),
            lower / n,
            np.sqrt(digits / n),
            np.sqrt(histogram[:33].sum() / n),
            np.sqrt(histogram[128:].sum() / n),
            *np.sqrt(histogram[list(MARKS)] / n),
        ],
        np.float32,
    )


N_STATISTICS = len(statistics(""))


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.float32))
        stats = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, N_STATISTICS, dtype=np.int32), flat)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], ["doc_id", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(_with_statistics), f"doc_id {id_type}, stats array<float>")


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray  # statistics x features
    phases: np.ndarray
    weights: np.ndarray
    at: np.ndarray  # raw scores and calibrated ones
    score: np.ndarray

    def expand(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        waves = np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(z), 1))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        raw = self.expand(stats) @ self.weights
        return np.clip(np.interp(raw, self.at, self.score), 0.0, 1.0)


def _stack(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)[column.offset : column.offset + len(column)].astype(np.float64) if len(column) else np.zeros((0, N_STATISTICS))


def _normal_equations(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.phases) + 1
        sums = np.zeros((2, size, size + 1))
        tag = None
        for batch in batches:
            x, y, fold = model.expand(_stack(batch.column("stats"))), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            tag = int(batch.column("tag")[0].as_py()) if tag is None and batch.num_rows else tag
            for f in (0, 1):
                part = x[fold == f]
                sums[f] += part.T @ np.hstack([part, y[fold == f][:, None]])
        if tag is not None:
            values = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, size + 1, dtype=np.int32), pa.array(sums.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size), pa.int32()), pa.array(np.tile(np.arange(size), 2), pa.int32()), pa.array(np.full(2 * size, tag), pa.int64()), values], ["fold", "row", "tag", "sums"])

    return run


def _add_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum(np.stack(pdf.sort_values("tag", kind="stable")["sums"].to_list()), axis=0)
    return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "row": [pdf["row"].iloc[0]], "sums": [total]})


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weighted means of y / n made non-decreasing by pooling adjacent violators."""
    pools: list[list[float]] = []
    for a, b in zip(y.tolist(), n.tolist(), strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a2, b2, c2 = pools.pop()
            pools[-1][0] += a2
            pools[-1][1] += b2
            pools[-1][2] += c2
    return np.concatenate([np.full(int(c), a / b) for a, b, c in pools]) if pools else np.zeros(0)


def train(stats: DataFrame, labels: DataFrame, *, features: int = 256, width: float = 1.0, ridge: float = 1e-3, seed: int = 7, bins: int = 2048) -> QualityModel:
    """stats: document_statistics of the documents; labels: doc_id, quality of those to learn from."""
    kept = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    rows = materialize(stats.join(kept, "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")), "quality-rows")
    each = [F.element_at("stats", i + 1).cast("double") for i in range(N_STATISTICS)]
    moments = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0)), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).head()
    n, ones = moments[0], moments[1]
    rng = np.random.default_rng(seed)
    mean, spread = (np.array([m or 0.0 for m in moments[a : a + N_STATISTICS]]) for a in (2, 2 + N_STATISTICS))
    model = QualityModel(
        mean, np.where(spread > 1e-9, spread, 1.0), rng.normal(size=(N_STATISTICS, features)) * width / np.sqrt(N_STATISTICS), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.full(1, ones / n if n else 0.5)
    )
    if not 0 < ones < n:
        return model
    parts = rows.withColumn("tag", F.spark_partition_id().cast("long")).mapInArrow(tidy(_normal_equations(model)), "fold int, row int, tag long, sums array<double>")
    size = features + 1
    total = np.zeros((2, size, size + 1))
    for r in parts.groupBy("fold", "row").applyInPandas(_add_rows, "fold int, row int, sums array<double>").collect():  # 2 * size rows
        total[r["fold"], r["row"]] = r["sums"]

    def solve(m: np.ndarray) -> np.ndarray:
        count = max(1.0, m[size - 1, size - 1])
        return np.linalg.solve(m[:, :size] + np.diag([ridge * count] * features + [1e-9]), m[:, size])

    model.weights = solve(total.sum(axis=0))
    honest = {f: QualityModel(**{**model.__dict__, "weights": solve(total[1 - f])}) for f in (0, 1)}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, fold = _stack(batch.column("stats")), batch.column("fold").to_numpy()
            raw = np.where(fold == 0, honest[0].expand(stats) @ honest[0].weights, honest[1].expand(stats) @ honest[1].weights)
            places = np.clip((raw + 0.5) / 2 * bins, 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(places), batch.column("y")], ["bin", "y"])

    counts = rows.mapInArrow(tidy(binned), "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # at most `bins` rows
    at = (np.array([r["bin"] for r in counts]) + 0.5) / bins * 2 - 0.5
    level = isotonic(np.array([r["y"] for r in counts]), np.array([float(r["n"]) for r in counts]))
    # A knot in the middle of each pool, so that scores rise between pools too.
    edges = np.flatnonzero(np.diff(level)) + 1
    pools = np.split(np.arange(len(level)), edges)
    model.at, model.score = np.array([at[p].mean() for p in pools]), np.array([level[p[0]] for p in pools])
    if len(pools) == 1:  # no order at all
        return model
    model.at = np.concatenate([[model.at[0] - 1], model.at, [model.at[-1] + 1]])
    model.score = np.concatenate([[model.score[0] * 0.9], model.score, [1 - 0.9 * (1 - model.score[-1])]])
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score, predicted from document_statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(_stack(batch.column("stats")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    id_type = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(tidy(run), f"doc_id {id_type}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs whose text the model does not reject, in one pass over the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t) for t in batch.column("text").to_pylist()]
            if stats:
                yield batch.filter(pa.array(model.scores(np.stack(stats).astype(np.float64)) >= 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
