"""Quality by naive Bayes support vectors.

Features are indicators of n-grams: single lower-cased words, and runs of one to three
word shapes, where a word's shape is what kinds of characters it is built of and a word
that repeats the one before it has a shape of its own. Class log-count ratios of the
n-grams are counted over all labelled documents; indicators are scaled by them and by
the length of the resulting vector. A linear model with hinge loss is fitted on a bounded
sample by dual coordinate descent, and a sigmoid fitted on labelled rows that the model
did not see turns margins into scores.

Defined results: a null or empty text has no n-gram and scores what the bias gives.
Labels that are null do not count; of several labels of a document the largest does.
Where only one class is labelled, every score is that class. Without labels every score
is 0.5. Repeated rows score alike; an empty table gives no rows. Columns of documents
other than the id and the text are not looked at.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.llm.common import held_out, packed, small_batches, unpacked
from dayglass.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_KINDS = ((re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"))
_RUN = re.compile(r"(.)\1+")
_CACHED_WORDS = 150_000  # memory of a worker; scores do not depend on it
_LONG_SHAPE = 12


@dataclass(frozen=True)
class QualityParams:
    """``rows`` bounds the labelled documents that the linear model is fitted on."""

    rows: int = 20_000
    bits: int = 18
    smoothing: float = 1.0
    cost: float = 1.0
    sweeps: int = 10
    threshold: float = 0.5


def word_shape(word: str) -> str:
    """Kinds of characters in order, runs of one kind once: ``Word,`` is ``Aa,``."""
    for pattern, kind in _KINDS:
        word = pattern.sub(lambda m, k=kind: "\0" + k, word)
    word = _RUN.sub(r"\1\1", word.replace("\0", ""))
    # a longer shape keeps its two ends and a digest of all of it
    return word if len(word) <= _LONG_SHAPE else f"{word[:4]}~{zlib.crc32(word.encode('utf-8', 'surrogatepass'))}~{word[-4:]}"


class Extractor:
    """N-gram slots of whole texts; words and shape runs are looked up once known."""

    def __init__(self, params: QualityParams):
        self._mask = (1 << params.bits) - 1
        self._words: dict[str, tuple[str, int]] = {}
        self._runs: dict[tuple[str, ...], int] = {}

    def _slot(self, text: str) -> int:
        return zlib.crc32(text.encode("utf-8", "surrogatepass")) & self._mask

    def slots(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if len(self._words) > _CACHED_WORDS:
            self._words = {}
        if len(self._runs) > _CACHED_WORDS:
            self._runs = {}
        distinct = set(words)
        for w in distinct:
            if w in self._words:
                continue
            self._words[w] = (word_shape(w), self._slot("w " + w.lower()))
        shapes = [self._words[w][0] for w in words]
        again = [i for i in range(1, len(words)) if words[i] == words[i - 1]]
        for i in again:
            shapes[i] = "="
        runs = {(s,) for s in set(shapes)}
        runs.update(zip(shapes, shapes[1:]))
        runs.update(zip(shapes, shapes[1:], shapes[2:]))
        for r in runs:
            if r not in self._runs:
                self._runs[r] = self._slot("s " + " ".join(r))
        found = {self._words[w][1] for w in distinct}
        found.update(self._runs[r] for r in runs)
        return np.sort(np.fromiter(found, dtype=np.int64, count=len(found)))


def fit_dual(
    rows: list[np.ndarray],
    values: list[np.ndarray],
    signs: np.ndarray,
    dims: int,
    cost: np.ndarray,
    sweeps: int,
    seed: int = 0,
    tolerance: float = 1e-4,
) -> np.ndarray:
    """Hinge-loss weights by dual coordinate descent; the last weight is the bias.

    A sweep that moves no multiplier by more than ``tolerance`` is the last.
    """
    w, alpha = np.zeros(dims + 1), np.zeros(len(rows))
    squares = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = signs[i] * (values[i] @ w[rows[i]] + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / squares[i], 0.0), cost[i])
            change = (new - alpha[i]) * signs[i]
            if change:
                w[rows[i]] += change * values[i]
                w[-1] += change
                moved = max(moved, abs(change))
                alpha[i] = new
        if moved < tolerance:
            break
    return w


def fit_sigmoid(margins: np.ndarray, truth: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of P(1 | margin) by Newton steps on smoothed targets."""
    ones, zeros = truth.sum(), (1 - truth).sum()
    target = np.where(truth == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, np.log((ones + 1) / (zeros + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g = np.array([(margins * (p - target)).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(margins * margins * v).sum(), (margins * v).sum()], [(margins * v).sum(), v.sum()]])
        move = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(max(a, 1e-6)), float(b)


@dataclass(frozen=True)
class QualityModel:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    params: QualityParams


def _scaled(slots: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    v = ratios[slots]
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    params: QualityParams = QualityParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "quality",
) -> QualityModel | float:
    """Count ratios over all labelled rows, then fit on the sample. A number where one class is missing."""
    small_batches(docs.sparkSession)
    dims = 1 << params.bits
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(~held_out(F.col("_id")))
    marked = labels.select(F.col(label_id).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y is not null")
    marked = marked.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = Extractor(params)
        for batch in batches:
            slots = [extractor.slots(t).astype(np.int32) for t in batch["_text"]]
            yield pd.DataFrame({"_id": batch["_id"].astype("string"), "_y": batch["_y"], "_slots": slots})

    # labels grow with the documents: always a shuffled join, the same at every size
    rows = texts.join(marked.hint("merge"), "_id").mapInPandas(extract, "_id string, _y int, _slots array<int>")
    rows = materialise(rows, "quality-features")
    # at most ``2 ** bits`` rows, combined before the shuffle
    counted = (
        rows.select("_y", F.explode("_slots").alias("_slot"))
        .groupBy("_slot")
        .agg(F.count_if(F.col("_y") == 1).alias("_good"), F.count_if(F.col("_y") != 1).alias("_bad"))
    )
    total, good = rows.agg(F.count(F.lit(1)), F.count_if(F.col("_y") == 1)).first()
    if not total or good in (0, total):
        return 0.5 if not total else float(good > 0)
    found = counted.toPandas()
    at = found["_slot"].to_numpy()
    p, q = (np.full(dims, params.smoothing) for _ in range(2))
    p[at] += found["_good"].to_numpy(dtype=float)
    q[at] += found["_bad"].to_numpy(dtype=float)
    ratios = np.log(p / p.sum()) - np.log(q / q.sum())
    unseen = np.ones(dims, dtype=bool)
    unseen[at] = False
    ratios[unseen] = 0.0

    def train(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("_id")
        slots = [np.asarray(s, dtype=np.int64) for s in sample["_slots"]]
        values = [_scaled(s, ratios) for s in slots]
        truth = (sample["_y"].to_numpy() == 1).astype(float)
        spare = np.array([zlib.crc32(b"spare" + str(i).encode()) % 4 == 0 for i in sample["_id"]])
        if len(set(truth[spare])) < 2 or len(set(truth[~spare])) < 2:
            spare[:] = False
        own = np.flatnonzero(~spare)
        share = np.where(truth[own] == 1, truth[own].mean(), 1 - truth[own].mean())
        w = fit_dual(
            [slots[i] for i in own],
            [values[i] for i in own],
            2 * truth[own] - 1,
            dims,
            params.cost * 0.5 / share,
            params.sweeps,
        )
        margins = np.array([v @ w[s] for s, v in zip(slots, values)]) + w[-1]
        rest = spare if spare.any() else ~spare
        slope, offset = fit_sigmoid(margins[rest], truth[rest])
        return pd.DataFrame({"weights": [w.astype(np.float32).tolist()], "slope": [slope], "offset": [offset]})

    # ``rows`` documents at most
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(params.rows)
    fitted = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
        train, "weights array<float>, slope double, offset double"
    ).first()
    w = np.asarray(fitted["weights"], dtype=np.float64)
    return QualityModel(ratios, w[:-1], float(w[-1]), fitted["slope"], fitted["offset"], params)


def score(spark: SparkSession, model: QualityModel | float, text: Column) -> Column:
    """Score 0..1 of whole texts; the model's size is fixed by its parameters."""
    if isinstance(model, float):
        return F.lit(model)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        extractor = Extractor(model.params)
        for texts in batches:
            margins = []
            for t in texts:
                slots = extractor.slots(t)
                margins.append(_scaled(slots, model.ratios) @ model.weights[slots] if len(slots) else 0.0)
            z = model.slope * (np.asarray(margins, dtype=np.float64) + model.bias) + model.offset
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return of(text)


def quality(
    docs: DataFrame,
    labels: DataFrame,
    params: QualityParams = QualityParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Fit, then score every document: id, ``held_out``, ``score``, ``predicted``."""
    model = fit(docs, labels, params, id_col, text_col)
    scored = docs.select(
        F.col(id_col).alias("_id"), score(docs.sparkSession, model, F.col(text_col)).alias("score")
    )
    return scored.select(
        F.col("_id").alias(id_col),
        held_out(F.col("_id")).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
    )


def drop_poor(
    docs: DataFrame,
    labels: DataFrame,
    params: QualityParams = QualityParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents scored at the threshold or above, all their columns."""
    model = fit(docs, labels, params, id_col, text_col)
    rows = packed(docs, id_col, text_col)
    return unpacked(rows.where(score(docs.sparkSession, model, F.col("_text")) >= params.threshold))
