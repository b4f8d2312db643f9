"""Best ensemble weights: all choices of weights over a compressed table of score cells.

Users with equal scores are one cell with its positives and negatives. A first pass scores
all choices of a batch of cells at once and counts them in bins of the combined score. The
counts bound the F1 that any threshold inside a bin can reach, so most bins are out; the
second pass tells single scores apart in the bins that are left only. The result is that
of a sweep over every distinct score of every choice.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayglass.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 2_048


def score_cells(scored: DataFrame, scores: list[str], label: str = "true_label") -> DataFrame:
    """Written table of distinct score tuples with ``pos`` and ``neg`` (cells of parts add up)."""
    counted = scored.groupBy(*scores).agg(
        F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg")
    )
    return materialise(counted, "score-cells")


def _combined(cells: pd.DataFrame, scores: list[str], weights: np.ndarray) -> np.ndarray:
    """Cells x choices; added model by model, so the sums are those of a column expression."""
    parts = [cells[s].to_numpy()[:, None] * weights[None, :, i] for i, s in enumerate(scores)]
    return reduce(np.add, parts, np.zeros((len(cells), len(weights))))


def _bin(total: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(total * BINS), 0, BINS - 1).astype(np.int64)


def _f1(tp: np.ndarray, fp: np.ndarray, positives: float) -> np.ndarray:
    whole = positives + tp + fp
    return np.divide(2.0 * tp, whole, out=np.zeros(len(whole)), where=whole > 0)


def _binned(cells: DataFrame, scores: list[str], weights: np.ndarray) -> pd.DataFrame:
    """Positives and negatives per choice and bin: at most choices x bins rows."""
    choices = len(weights)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg = np.zeros(choices * BINS), np.zeros(choices * BINS)
        for batch in batches:
            at = (np.arange(choices) * BINS + _bin(_combined(batch, scores, weights))).ravel()
            pos += np.bincount(at, np.repeat(batch["pos"].to_numpy(float), choices), choices * BINS)
            neg += np.bincount(at, np.repeat(batch["neg"].to_numpy(float), choices), choices * BINS)
        used = np.flatnonzero(pos + neg)
        yield pd.DataFrame({"at": used, "pos": pos[used].astype(np.int64), "neg": neg[used].astype(np.int64)})

    parts = cells.mapInPandas(count, "at long, pos long, neg long")
    return parts.groupBy("at").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas()


def _open_bins(found: pd.DataFrame, choices: int, positives: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bins of each choice may hold its best threshold, and the counts above each bin."""
    pos, neg = np.zeros(choices * BINS), np.zeros(choices * BINS)
    pos[found["at"].to_numpy(np.int64)], neg[found["at"].to_numpy(np.int64)] = found["pos"], found["neg"]
    pos, neg = pos.reshape(choices, BINS), neg.reshape(choices, BINS)
    tp, fp = (np.cumsum(c[:, ::-1], axis=1)[:, ::-1] for c in (pos, neg))
    above_tp, above_fp = tp - pos, fp - neg
    reached = np.stack([_f1(a, b, positives) for a, b in zip(tp, fp)])
    possible = np.stack([_f1(a, b, positives) for a, b in zip(tp, above_fp)])
    used = pos + neg > 0
    # a hair of slack for rounding: an open bin costs time only
    lowest = np.where(used, reached, 0.0).max(axis=1, keepdims=True)
    return used & (possible >= lowest - 1e-12), above_tp, above_fp


def best_thresholds(cells: DataFrame, scores: list[str], choices: list[tuple[float, ...]]) -> DataFrame:
    """``choice, threshold, f1_score``: for each choice its best F1 (``>=``), the lowest threshold on ties."""
    spark, weights = cells.sparkSession, np.array(choices, dtype=float)
    positives = cells.agg(F.sum("pos")).first()[0] or 0
    open_, above_tp, above_fp = _open_bins(_binned(cells, scores, weights), len(choices), positives)
    shared = spark.sparkContext.broadcast(open_)

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = _combined(batch, scores, weights)
            place = _bin(total)
            row, choice = np.nonzero(shared.value[np.arange(len(weights)), place])
            yield pd.DataFrame(
                {
                    "choice": choice.astype(np.int32),
                    "bin": place[row, choice],
                    "score": total[row, choice],
                    "pos": batch["pos"].to_numpy()[row],
                    "neg": batch["neg"].to_numpy()[row],
                }
            )

    rows = cells.mapInPandas(single, "choice int, bin long, score double, pos long, neg long")
    steps = rows.groupBy("choice", "bin", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    down = Window.partitionBy("choice", "bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    choice, place = np.nonzero(open_)
    # at most choices x bins rows
    starts = spark.createDataFrame(
        pd.DataFrame({"choice": choice.astype(np.int32), "bin": place, "tp": above_tp[open_], "fp": above_fp[open_]}),
        "choice int, bin long, tp double, fp double",
    )
    running = steps.withColumns({"_tp": F.sum("pos").over(down), "_fp": F.sum("neg").over(down)}).join(starts, ["choice", "bin"])
    tp, fp = F.col("tp") + F.col("_tp"), F.col("fp") + F.col("_fp")
    f1 = F.coalesce(F.try_divide(2.0 * tp, positives + tp + fp), F.lit(0.0))
    points = running.select("choice", F.col("score").alias("threshold"), f1.alias("f1_score"))
    best = F.max_by(F.struct("threshold", "f1_score"), F.struct(F.col("f1_score"), -F.col("threshold")))
    return points.groupBy("choice").agg(best.alias("b")).select("choice", "b.*")
