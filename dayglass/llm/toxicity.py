"""Toxicity by non-negative positive-unlabelled learning.

Classifiers see confirmed toxic documents and unlabelled ones, never a negative label.
The risk of the negatives is the unlabelled risk less the share ``prior`` of the positive
one; where a batch drives it below zero, the step goes the other way, so the classifier
cannot fit the unlabelled documents without bound. Linear numpy classifiers are trained
side by side on executors, each without one fold of the sample. On its own fold, slope
and offset of its margins are fitted with the same risk, which needs no correction there
as two numbers cannot overfit. The margins are averaged.

Features: hashed beginnings of a document's distinct words, counted and divided by the
square root of the number of distinct words. What follows a word's fifth letter is not
read: whole words and n-grams beside the beginnings were measured and lower the held-out
recall (README). A run of letters in writing without spaces is no word: its n-grams of two
and three characters from every place count, and all of it.
Every word's weight is looked up once, so scoring costs a set and a sum per document.

Defined results: a null, empty or wordless text scores what no evidence gives. Labels
that are null do not count; of several labels of a document the largest does. Without
any positive label every score is 0. Repeated rows score alike; an empty table gives no
rows. Columns of documents other than the id and the text are not looked at.
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

from dayglass.llm.common import hand_back, held_out, packed, small_batches, unpacked
from dayglass.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LETTERS = re.compile(r"[^\W\d_]+")
# Lao and Thai, Burmese, Khmer, kana, Han: writing without spaces
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_CACHED_WORDS = 150_000  # memory of a worker; scores do not depend on it


_RIDGE = 1e-4  # keeps the slope finite where positives and unlabelled part completely


@dataclass(frozen=True)
class ToxicityParams:
    """``positives`` and ``unlabelled`` bound the documents that fitting looks at."""

    positives: int = 6_000
    unlabelled: int = 12_000
    classifiers: int = 3
    bits: int = 18
    heads: tuple[int, ...] = (3, 4, 5)
    epochs: int = 12
    batch: int = 256
    rate: float = 0.05
    decay: float = 1e-4
    threshold: float = 0.7


def distinct_words(text: str | None) -> set[str]:
    return set(_LETTERS.findall((text or "").lower()))


def word_features(word: str, params: ToxicityParams) -> list[int]:
    """Slots of a word's beginnings, or of all n-grams of a run without spaces; of all of it where it is shorter."""
    mask = (1 << params.bits) - 1
    if _UNSPACED.search(word):
        parts = ["~" + word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)] + [word + "$"]
    else:
        parts = [word[:n] for n in params.heads if n <= len(word)] or [word + "$"]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) & mask for p in dict.fromkeys(parts)]


def _sampled(texts: DataFrame, n: int) -> DataFrame:
    """``n`` ids with the smallest hash; the bound makes them fit to be broadcast."""
    ids = texts.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(n)
    return texts.join(F.broadcast(ids.distinct()), "_id")


def _loss_slope(z: np.ndarray) -> np.ndarray:
    """Slope of log(1 + exp(-z))."""
    return -1.0 / (1.0 + np.exp(np.clip(z, -30, 30)))


class _Rows:
    """Sparse rows: slots and values end to end."""

    def __init__(self, slots: list[np.ndarray], norms: np.ndarray):
        self.at = np.concatenate([[0], np.cumsum([len(s) for s in slots])]).astype(np.int64)
        self.slots = np.concatenate(slots) if slots else np.empty(0, np.int32)
        self.scale = norms

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spans = [self.slots[self.at[r] : self.at[r + 1]] for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in spans])
        return np.concatenate(spans), owner, self.scale[rows]


def fit_nnpu(
    positive: list[np.ndarray],
    positive_scale: np.ndarray,
    unlabelled: list[np.ndarray],
    unlabelled_scale: np.ndarray,
    prior: float,
    params: ToxicityParams,
    seed: int = 0,
) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with the logistic loss."""
    p, u = _Rows(positive, positive_scale), _Rows(unlabelled, unlabelled_scale)
    dims = 1 << params.bits
    w, first, second = (np.zeros(dims + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    rng = np.random.default_rng(seed)
    rounds = max(1, -(-len(unlabelled) // params.batch))
    share = min(len(positive), params.batch)
    step = 0
    for _ in range(params.epochs):
        up, pp = rng.permutation(len(unlabelled)), rng.permutation(len(positive))
        for k in range(rounds):
            step += 1
            rows_u = up[k * params.batch : (k + 1) * params.batch]
            rows_p = np.take(pp, np.arange(k * share, (k + 1) * share), mode="wrap")
            ps, po, pn = p.take(rows_p)
            us, uo, un = u.take(rows_u)
            zp = np.bincount(po, w[ps], len(rows_p)) * pn + w[-1]
            zu = np.bincount(uo, w[us], len(rows_u)) * un + w[-1]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            # slopes of the risks by margin
            up_slope = -_loss_slope(-zu) / len(rows_u)
            down_slope = prior * _loss_slope(-zp) / len(rows_p)
            if negative >= 0:
                slope_p, slope_u = prior * _loss_slope(zp) / len(rows_p) + down_slope, up_slope
            else:
                slope_p, slope_u = -down_slope, -up_slope
            grad = np.bincount(ps, (slope_p * pn)[po], dims + 1) + np.bincount(us, (slope_u * un)[uo], dims + 1)
            grad[-1] = slope_p.sum() + slope_u.sum()
            grad[:-1] += params.decay * w[:-1]
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            rate = params.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            w -= rate * first / (np.sqrt(second) + 1e-8)
    return w[:-1], float(w[-1])


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that minimise the positive-unlabelled risk of fixed margins.

    With the logistic loss that risk is convex: the mean of log(1 + exp(z)) over the
    unlabelled, less ``prior`` times the mean of z over the positives. Newton steps.
    """
    a, b = 1.0, 0.0
    if not len(positive) or not len(unlabelled):
        return a, b
    pull = prior * np.array([positive.mean(), 1.0])
    x = np.stack([unlabelled, np.ones_like(unlabelled)])

    def risk(a: float, b: float) -> float:
        return np.logaddexp(0, a * unlabelled + b).mean() - a * pull[0] - b * pull[1] + _RIDGE * a * a

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * unlabelled + b, -35, 35)))
        slope = (x * p).mean(axis=1) - pull + [2 * _RIDGE * a, 0.0]
        curve = (x * (p * (1 - p))) @ x.T / len(unlabelled) + np.diag([2 * _RIDGE, 1e-6])
        move, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-4 and risk(a - size * move[0], b - size * move[1]) > risk(a, b):
            size /= 2
        a, b = a - size * move[0], b - size * move[1]
        if np.abs(size * move).max() < 1e-6:
            break
    return float(max(a, 0.01)), float(b)


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    params: ToxicityParams


def fit(
    docs: DataFrame,
    labels: DataFrame,
    params: ToxicityParams = ToxicityParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "toxic",
) -> ToxicityModel | None:
    """Train the classifiers; None without a document of a positive label. Held-out documents are not looked at."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(~held_out(F.col("_id")))
    marked = labels.select(F.col(label_id).alias("_id"), F.col(label_col).alias("_y")).where(~held_out(F.col("_id")))
    marked = materialise(marked.where("_y is not null").groupBy("_id").agg(F.max("_y").alias("_y")), "toxic-labels")
    known, toxic = marked.agg(F.count(F.lit(1)), F.count_if(F.col("_y") == 1)).first()
    if not toxic:
        return None
    prior = min(max(toxic / known, 1e-3), 0.9)
    confirmed = _sampled(texts.join(marked.where("_y = 1").select("_id"), "_id"), params.positives)
    other = _sampled(texts, params.unlabelled)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots, scale = [], []
            for text in batch["_text"]:
                words = sorted(distinct_words(text))
                slots.append([f for w in words for f in word_features(w, params)])
                scale.append(1 / max(1.0, len(words)) ** 0.5)
            yield pd.DataFrame({"_id": batch["_id"].astype("string"), "_known": batch["_known"], "_slots": slots, "_scale": scale})

    both = confirmed.withColumn("_known", F.lit(True)).unionByName(other.withColumn("_known", F.lit(False)))
    rows = both.mapInPandas(extract, "_id string, _known boolean, _slots array<int>, _scale double")
    folds = F.pmod(F.xxhash64("_id"), F.lit(params.classifiers)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(params.classifiers - 1)))
    # each classifier meets all of the sample, its own fold for calibration alone
    dealt = materialise(rows.select("*", folds.alias("_fold"), each.alias("_bag")), "toxic-features")
    # labels may be of other documents only
    told = dealt.agg(F.count_if("_known"), F.count_if(~F.col("_known"))).first()
    if not all(told):
        return None

    def train(bag: pd.DataFrame) -> pd.DataFrame:
        bag = bag.sort_values(["_known", "_id"])
        own = bag["_fold"].to_numpy() == bag["_bag"].to_numpy()
        known = bag["_known"].to_numpy(dtype=bool)
        slots = [np.asarray(s, dtype=np.int32) for s in bag["_slots"]]
        scale = bag["_scale"].to_numpy()
        if not (known & ~own).any() or not (~known & ~own).any():
            own = np.zeros(len(bag), dtype=bool)
        p, u = np.flatnonzero(known & ~own), np.flatnonzero(~known & ~own)
        w, bias = fit_nnpu(
            [slots[i] for i in p], scale[p], [slots[i] for i in u], scale[u], prior, params, int(bag["_bag"].iloc[0])
        )
        margins = np.array([w[s].sum() for s in slots]) * scale + bias
        a, b = calibrate(margins[known & own], margins[~known & own], prior)
        return pd.DataFrame({"weights": [(a * w).astype(np.float32).tolist()], "bias": [a * bias + b]})

    # ``positives`` + ``unlabelled`` documents at most
    fitted = dealt.groupBy("_bag").applyInPandas(train, "weights array<float>, bias double").collect()
    weights = np.mean([np.asarray(r["weights"], dtype=np.float64) for r in fitted], axis=0)
    return ToxicityModel(weights, float(np.mean([r["bias"] for r in fitted])), params)


def score(spark: SparkSession, model: ToxicityModel | None, text: Column) -> Column:
    """Score 0..1 of whole texts; the model's size is fixed by its parameters."""
    if model is None:
        return F.lit(0.0)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        weights, known = model.weights, {}

        for texts in batches:
            margins = []
            for t in texts:
                words = distinct_words(t)
                for w in words:
                    if w in known:
                        continue
                    known[w] = float(weights[word_features(w, model.params)].sum())
                # sorted sum: the same whatever order the set has
                margins.append(np.sort([known[w] for w in words]).sum() / max(1.0, len(words)) ** 0.5)
                if len(known) > _CACHED_WORDS:
                    known = {}
            z = np.clip(np.asarray(margins, dtype=np.float64) + model.bias, -35, 35)
            yield pd.Series(1 / (1 + np.exp(-z)))
        hand_back()

    return of(text)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    params: ToxicityParams = ToxicityParams(),
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


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    params: ToxicityParams = ToxicityParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents scored below the threshold, all their columns."""
    model = fit(docs, labels, params, id_col, text_col)
    rows = packed(docs, id_col, text_col)
    return unpacked(rows.where(score(docs.sparkSession, model, F.col("_text")) < params.threshold))
