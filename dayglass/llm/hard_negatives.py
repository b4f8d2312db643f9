"""Hard negatives by a vertical scan (BOND: branch and bound on decomposed data).

Vectors become integers and are stored by dimension: a block is one row that holds some
thousand vectors as one array for each dimension, with each dimension's least and largest
value. An anchor reads the dimensions of a block in descending magnitude of its own
components. After every few dimensions the least and largest contributions of those not
read yet bound each candidate's score from both sides, and candidates that can no longer
matter leave the candidate set; what is left at the end has its exact score. A block whose
bounds rule out all its vectors is not read at all.

Two scans do the work. The first finds each anchor's positives, the best rows of its own
label. The second finds, for every positive, the best rows of other labels whose scores
lie in the window that the positive's score opens. Blocks hold one label each where a
label has enough rows, so the first scan reads few of them. Anchors come in rounds of
bounded size: a round's anchors and what they found so far are all that is broadcast, and
each task carries its anchors' running bests from block to block, so it sends a few rows
for each anchor, however many vectors it reads.

Defined results: rows with a null id or label, a null vector, or a null or non-finite
component take no part; an id is needed to name a row. Rows that repeat id, label and
vector count once; rows of one id never are each other's positives or negatives. Equal
scores go by smaller id. An anchor without positives gives no rows, and so does a positive
whose window holds nothing, as it does where its score is negative. Vectors of unlike
length, and components so large that scores might not fit into 64 bits, are refused. Empty
tables give no rows. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass.llm.common import broadcast_if_small, finite, floored
from dayglass.session import materialise, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4_096  # vectors of a block, about
ROUND = 8_192  # anchors of a round, about: what is broadcast at once
STEP = 8  # dimensions that are read between two looks at the bounds
BLOCKS_PER_TASK = 16

_BLOCKS = "ids array<long>, labels array<long>, columns array<array<long>>, low array<long>, high array<long>"
_FOUND = "anchor int, place int, id long, score long"


@dataclass(frozen=True)
class Rule:
    """How many positives and negatives, and the window: low * positive <= unit * negative <= high * positive."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    unit: int = 100


def integer_rows(
    vectors: DataFrame, scale: int, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Rows (``_id``, ``_label``, ``_x``) that take part: each component is floor(scale * component)."""
    present = F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
    return vectors.where(present & finite(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"), floored(F.col(vec_col), scale).alias("_x")
    )


def _columnar(group: pa.Table) -> pa.Table:
    """One block: rows in order of id, repeated ones once, vectors by dimension."""
    ids, labels = (group.column(c).to_numpy() for c in ("_id", "_label"))
    lists = group.column("_x").combine_chunks()
    x = lists.flatten().to_numpy().reshape(len(ids), -1)
    rows = np.unique(np.column_stack([ids, labels, x]), axis=0)
    ids, labels, x = rows[:, 0], rows[:, 1], rows[:, 2:]
    low = x.min(axis=0) if x.size else np.empty(0, dtype=np.int64)
    high = x.max(axis=0) if x.size else np.empty(0, dtype=np.int64)
    return pa.table(
        {
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "labels": pa.array([labels], pa.list_(pa.int64())),
            "columns": pa.array([list(np.ascontiguousarray(x.T))], pa.list_(pa.list_(pa.int64()))),
            "low": pa.array([low], pa.list_(pa.int64())),
            "high": pa.array([high], pa.list_(pa.int64())),
        }
    )


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The vectors by dimension, in blocks of about ``block``.

    A label with that many rows is dealt over blocks of its own by a hash of the id; smaller
    labels share blocks.
    """
    counts = materialise(rows.groupBy("_label").agg(F.count(F.lit(1)).alias("_n")), "bond-labels")
    total = counts.agg(F.sum("_n"), F.sum(F.when(F.col("_n") < block, F.col("_n")))).first()
    shared = -(-(total[1] or 0) // block) or 1
    large = F.col("_n") >= block
    part = F.when(large, F.col("_label"))
    deal = F.when(large, F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / block))).otherwise(F.pmod(F.xxhash64("_label"), F.lit(shared)))
    dealt = rows.join(broadcast_if_small(counts), "_label").select("_id", "_label", "_x", part.alias("_part"), deal.alias("_deal"))
    built = dealt.groupBy("_part", "_deal").applyInArrow(_columnar, _BLOCKS)
    # the scans are work for the processor: more tasks than the bytes alone would get
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(total[0] or 0) // (block * BLOCKS_PER_TASK)))
    return materialise(built.repartition(tasks), "bond-blocks")


@dataclass(frozen=True)
class Anchors:
    """A round's anchors, and for each of them the windows that its positives open."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    least: np.ndarray | None = None  # anchors x windows; a window that holds nothing is null
    most: np.ndarray | None = None
    open: np.ndarray | None = None


class _Block:
    """One block and what it can add to an anchor's score."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.ids, self.labels, self.columns, self.low, self.high = ids, labels, columns, low, high
        self.one_label = int(labels[0]) if len(labels) and (labels[0] == labels).all() else None

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of any vector here, for each anchor."""
        up, down = np.maximum(x, 0), np.minimum(x, 0)
        return up @ self.low + down @ self.high, up @ self.high + down @ self.low

    def candidates(self, anchor_id: int, label: int, same: bool) -> np.ndarray:
        """Places of the rows with (or without) the anchor's label that are not of its id."""
        if self.one_label is None:
            wanted = (self.labels == label) == same
        elif (self.one_label == label) != same:
            return np.empty(0, dtype=np.int64)
        else:
            wanted = np.ones(len(self.ids), dtype=bool)
        first, end = np.searchsorted(self.ids, [anchor_id, anchor_id + 1])
        wanted[first:end] = False
        return np.flatnonzero(wanted)

    def scan(self, q: np.ndarray, at: np.ndarray, least: float, most: float, best: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the candidates ``at`` that may score ``least`` to ``most``.

        With ``best``, those that cannot be among that many best ones leave as well.
        """
        order = np.argsort(-np.abs(q), kind="stable")
        # what the dimensions from place j on can still add
        ends = np.sort(np.stack([q * self.low, q * self.high]), axis=0)[:, order]
        rest = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1), dtype=ends.dtype)], axis=1)
        score = np.zeros(len(at), dtype=self.columns.dtype)
        for j in range(0, len(q), STEP):
            if not len(at):
                break
            dims = order[j : j + STEP]
            held = self.columns[dims] if len(at) == len(self.ids) else self.columns[np.ix_(dims, at)]
            score += q[dims] @ held
            j = min(j + STEP, len(q))
            floor = least
            if best is not None and len(at) > best:
                floor = max(floor, np.partition(score, len(at) - best)[len(at) - best] + rest[0, j])
            alive = (score + rest[1, j] >= floor) & (score + rest[0, j] <= most)
            if not alive.all():
                at, score = at[alive], score[alive]
        return at, score


def _merged(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` best of two sets: higher scores first, ties by smaller id."""
    scores, ids = np.concatenate([scores, more]), np.concatenate([ids, more_ids])
    first = np.lexsort((ids, -scores))[:n]
    return scores[first], ids[first]


def _blocks(batches: Iterator[pa.RecordBatch], dtype: type) -> Iterator[_Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            lists = {c: batch.column(c)[row].values for c in ("ids", "labels", "columns", "low", "high")}
            columns = lists.pop("columns")
            flat = columns.flatten().to_numpy().reshape(len(columns), -1).astype(dtype)
            ids, labels, low, high = (v.to_numpy() for v in lists.values())
            yield _Block(ids, labels, flat, low.astype(dtype), high.astype(dtype))


def _batch(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (anchor, place, id, score)."""
    sizes = [len(ids) for _, _, ids, _ in found]
    none = np.empty(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat([a for a, _, _, _ in found], sizes).astype(np.int32)),
            pa.array(np.repeat([w for _, w, _, _ in found], sizes).astype(np.int32)),
            pa.array(np.concatenate([none, *[i for _, _, i, _ in found]]).astype(np.int64)),
            pa.array(np.concatenate([none, *[s for _, _, _, s in found]]).astype(np.int64)),
        ],
        names=["anchor", "place", "id", "score"],
    )


def _positives(blocks: DataFrame, anchors: Anchors, rule: Rule, dtype: type) -> DataFrame:
    """Each task's best rows of each anchor's own label."""
    shared = blocks.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        x = own.x.astype(dtype)
        none = np.empty(0, dtype=dtype), np.empty(0, dtype=np.int64)
        best = [none] * len(x)
        for block in _blocks(batches, dtype):
            highest = block.bounds(x)[1]
            present = np.isin(own.labels, np.unique(block.labels))
            for i in np.flatnonzero(present):
                full = len(best[i][0]) == rule.positives
                least = best[i][0][-1] if full else -np.inf
                if highest[i] < least:
                    continue
                at = block.candidates(own.ids[i], own.labels[i], True)
                at, score = block.scan(x[i], at, least, np.inf, rule.positives)
                best[i] = _merged(*best[i], score, block.ids[at], rule.positives)
        yield _batch([(i, 0, ids, scores) for i, (scores, ids) in enumerate(best)])

    return blocks.mapInArrow(scan, _FOUND)


def _negatives(blocks: DataFrame, anchors: Anchors, rule: Rule, dtype: type) -> DataFrame:
    """Each task's best rows of other labels in each window of each anchor."""
    shared = blocks.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        x = own.x.astype(dtype)
        none = np.empty(0, dtype=dtype), np.empty(0, dtype=np.int64)
        best = [[none] * own.open.shape[1] for _ in range(len(x))]
        # rises to the last of a window's best ones once there are enough
        need = np.where(own.open, own.least.astype(float), np.inf)
        most = np.where(own.open, own.most.astype(float), -np.inf)
        for block in _blocks(batches, dtype):
            lowest, highest = block.bounds(x)
            reached = own.open & (highest[:, None] >= need) & (lowest[:, None] <= most)
            if block.one_label is not None:
                reached &= (own.labels != block.one_label)[:, None]
            for i in np.flatnonzero(reached.any(axis=1)):
                windows = np.flatnonzero(reached[i])
                at = block.candidates(own.ids[i], own.labels[i], False)
                at, score = block.scan(x[i], at, need[i, windows].min(), most[i, windows].max(), None)
                for w in windows:
                    inside = (score >= need[i, w]) & (score <= most[i, w])
                    if inside.any():
                        best[i][w] = _merged(*best[i][w], score[inside], block.ids[at[inside]], rule.negatives)
                        if len(best[i][w][0]) == rule.negatives:
                            need[i, w] = max(need[i, w], best[i][w][0][-1])
        yield _batch([(i, w, ids, scores) for i, each in enumerate(best) for w, (scores, ids) in enumerate(each)])

    return blocks.mapInArrow(scan, _FOUND)


def _first(found: DataFrame, n: int) -> DataFrame:
    """The best ``n`` of what all tasks found, ranked from 1; a few rows of each task meet here."""
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def _window(positives: list, n: int, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor and positive: least and largest score of a negative, and whether there can be any."""
    least, most = (np.zeros((n, rule.positives), dtype=np.int64) for _ in range(2))
    open_ = np.zeros((n, rule.positives), dtype=bool)
    for r in positives:
        at = r["anchor"], r["rank"] - 1
        least[at], most[at] = -(-rule.low * r["score"] // rule.unit), rule.high * r["score"] // rule.unit
        open_[at] = least[at] <= most[at]
    return least, most, open_


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    scale: int = 256,
    rule: Rule = Rule(),
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    block: int = BLOCK,
    round_size: int = ROUND,
) -> DataFrame:
    """Hard negatives of the rows that are anchors, against all rows.

    (``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score``,
    ``negative_score``); ``is_anchor`` is a condition on ``_id``, ``_label`` and ``_x``.
    """
    spark = vectors.sparkSession
    rows = materialise(integer_rows(vectors, scale, id_col, vec_col, label_col), "bond-rows")
    size = F.size("_x")
    largest = F.array_max(F.transform("_x", lambda c: F.greatest(c, -c)))
    seen = rows.agg(F.min(size).alias("d"), F.max(size).alias("d_max"), F.max(largest).alias("x")).first()
    nothing = spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    if not seen["d"]:
        return nothing
    if seen["d"] != seen["d_max"]:
        raise ValueError("vectors of unlike length")
    reach = seen["d"] * (seen["x"] or 0) ** 2
    if reach * rule.unit >= 1 << 63:
        raise OverflowError("scores of these components may not fit into 64 bits")
    dtype = np.float64 if reach < 1 << 53 else np.int64  # either is exact
    blocks = blocks_of(rows, block)
    anchors = rows.where(is_anchor).distinct()
    anchors = materialise(anchors, "bond-anchors")
    rounds = -(-anchors.count() // round_size)
    if not rounds:
        return nothing
    path = scratch_path(spark, "bond-found")
    for r in range(rounds):
        # about ``round_size`` rows, whatever the number of anchors
        held = anchors.where(F.pmod(F.xxhash64("_id", "_x"), F.lit(rounds)) == r).orderBy("_id", "_label", "_x").collect()
        ids, labels = (np.array([h[c] for h in held], dtype=np.int64) for c in ("_id", "_label"))
        x = np.array([h["_x"] for h in held], dtype=np.int64).reshape(len(held), seen["d"])
        own = Anchors(ids, labels, x)
        positives = materialise(_first(_positives(blocks, own, rule, dtype), rule.positives), "bond-positives")
        # at most a round's anchors times the positives of each
        windows = _window(positives.select("anchor", "rank", "score").collect(), len(held), rule)
        found = _first(_negatives(blocks, Anchors(ids, labels, x, *windows), rule, dtype), rule.negatives)
        opened = positives.select(
            "anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        )
        names = spark.createDataFrame([(i, int(k)) for i, k in enumerate(ids)], "anchor int, anchor_id long")
        joined = found.join(opened, ["anchor", "place"]).join(names, "anchor")
        joined.select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.parquet(f"{path}/round={r}")
    return spark.read.schema(nothing.schema).parquet(*[f"{path}/round={r}" for r in range(rounds)])
