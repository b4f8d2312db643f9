"""Several k-means runs over the same points, their rounds (Lloyd, 1982) in step.

One pass serves a round of all runs that still move: every task multiplies its points with
the centres of all of them and sends one small matrix. A pass has its price however few the
points are, so the runs of a fit cost as many passes as the longest of them, and not as
many as all of them together.

The rule is that of ``pyspark.ml``: a point belongs to its nearest centre, the first of equal
ones; a centre without points stays; a run ends when none of its centres has moved further
than the tolerance.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame, Row

# task functions travel with their code, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ROWS = 2_048  # points in a block, whose distances are held at a time
_TASK_BYTES = 8_000_000  # of points; the rounds of fewer take less time than the start of their task
_FAR = np.finfo(float).max


def in_worthy_tasks(points: DataFrame, size: int) -> DataFrame:
    """Partitions of a stored table put together until the rounds over one outweigh its task's start."""
    return points.coalesce(max(1, -(-points.count() * (size + 1) * 8 // _TASK_BYTES)))


def _packed(points: DataFrame) -> RDD:
    """Blocks of points, each with a 1 behind it, and of weights, as tasks multiply them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                z = part.column(0).flatten().to_numpy().reshape(part.num_rows, -1)
                rows = np.hstack([z, np.ones((len(z), 1))])
                weights = part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()]), pa.array([weights.tobytes()])], names=["points", "weights"])

    def unpack(row: Row) -> tuple[np.ndarray, np.ndarray]:
        weights = np.frombuffer(row[1])
        return np.frombuffer(row[0]).reshape(len(weights), -1), weights

    return points.mapInArrow(run, "points binary, weights binary").rdd.map(unpack)


def _round(blocks: RDD, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and weights of the points of each centre, and each run's cost.

    Costs are half the squared distances without the points' own squares, which are the same
    for all runs. Centres that are not there are NaN.
    """
    runs, clusters, size = centres.shape
    flat = centres.reshape(-1, size)
    # times (z, 1): half the squared distance without half the square of z
    half = np.hstack([-flat, (flat * flat).sum(axis=1, keepdims=True) / 2])
    half[np.isnan(half[:, -1])] = [*[0.0] * size, _FAR]

    def run(own_blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sums, cost = np.zeros(half.shape), np.zeros(runs)
        for z, weight in own_blocks:
            away = (half @ z.T).reshape(runs, clusters, -1)
            least = away.min(axis=1)
            own = away == least[:, None]
            if np.count_nonzero(own) > least.size:
                own &= np.cumsum(own, axis=1) == 1
            sums += np.multiply(own, weight, out=away).reshape(len(half), -1) @ z
            cost += least @ weight
        yield sums, cost

    # from each task as many numbers as the centres have; an RDD's pass needs no plan of its own
    parts = blocks.mapPartitions(run).collect()
    sums, cost = (sum(p[i] for p in parts) for i in range(2))
    return sums.reshape(runs, clusters, size + 1), cost


def best_centres(points: DataFrame, starts: list[np.ndarray], max_iter: int, tolerance: float) -> list[list[float]]:
    """Centres of the run of least cost, each run having gone on from its own ``starts``.

    ``points`` has an array and a weight; it is read once, and its blocks are stored.
    """
    centres = np.full((len(starts), max(map(len, starts)), starts[0].shape[1]), np.nan)
    for run, start in enumerate(starts):
        centres[run, : len(start)] = start
    costs = np.zeros(len(starts))
    moving = np.arange(len(starts))
    blocks = _packed(points).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(max_iter):
            before = centres[moving]
            sums, costs[moving] = _round(blocks, before)
            weights = sums[..., -1:]
            after = np.where(weights > 0, sums[..., :-1] / np.where(weights > 0, weights, 1.0), before)
            centres[moving] = after
            steps = np.nan_to_num(((after - before) ** 2).sum(axis=2)).max(axis=1)
            moving = moving[steps > tolerance**2]
            if not len(moving):
                break
    finally:
        blocks.unpersist()
    best = centres[np.argmin(costs)]
    return best[~np.isnan(best[:, 0])].tolist()
