"""Combining the scores of several models by key.

Predictions are long (``model, user, day, true_label, prediction,
anomaly_score``). One grouping by key lays the models side by side, so no model
is joined to another and the arithmetic has a fixed order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass import config
from dayglass.functions.numeric import min_max
from dayglass.operators.ordering import row_numbers, with_group_stats
from dayglass.operators.weight_search import best_thresholds, score_cells

KEYS = ("user", "day")


def side_by_side(
    predictions: DataFrame, keys: tuple[str, ...] = KEYS, models: tuple[str, ...] = config.MODELS
) -> DataFrame:
    """One row per key with ``score_<model>``, ``prediction_<model>`` and ``true_label``.

    Repeated rows of a model under one key count by their maximum; the label is
    that of the first listed model that has the key.
    """

    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column)))

    return (
        predictions.where(F.col("model").isin(*models))
        .groupBy(*keys)
        .agg(
            *[of(m, "anomaly_score").alias(f"score_{m}") for m in models],
            *[of(m, "prediction").alias(f"prediction_{m}") for m in models],
            F.coalesce(*[of(m, "true_label") for m in models]).alias("true_label"),
        )
    )


def align_left(
    predictions: DataFrame,
    keys: tuple[str, ...] = ("user",),
    base: str = "isolation_forest",
    models: tuple[str, ...] = config.MODELS,
    zero_filled: tuple[str, ...] = ("lstm_autoencoder",),
) -> DataFrame:
    """Keys of the base model with every model's score; absent sequence scores become 0."""
    wide = side_by_side(predictions, keys, models).where(F.col(f"score_{base}").isNotNull())
    fills = {f"score_{m}": F.coalesce(F.col(f"score_{m}"), F.lit(0.0)) for m in zero_filled if m in models}
    return wide.withColumns(fills)


def align_inner(
    predictions: DataFrame, keys: tuple[str, ...] = ("user",), models: tuple[str, ...] = config.MODELS
) -> DataFrame:
    """Only keys that every model scored."""
    wide = side_by_side(predictions, keys, models)
    for m in models:
        wide = wide.where(F.col(f"score_{m}").isNotNull())
    return wide


def align_by_position(
    predictions: DataFrame, keys: tuple[str, ...] = KEYS, models: tuple[str, ...] = config.MODELS
) -> DataFrame:
    """Models matched by row position, longer ones thinned evenly to the shortest.

    Kept for compatibility; joining on keys is the meaningful alignment. The
    output key is ``position``.
    """
    order = [F.col(k) for k in keys]
    kept = predictions.where(F.col("model").isin(*models))
    numbered = row_numbers(kept, order, ("model",), out="_row")
    sized = with_group_stats(numbered, ["model"], {"_n": F.count(F.lit(1))}, source=kept)
    shortest = kept.groupBy("model").agg(F.count(F.lit(1)).alias("c")).agg(F.min("c")).scalar()
    row = F.col("_row") - 1
    m, n = F.col("_m"), F.col("_n")
    gap = (n - 1).cast("double") / F.greatest(m - 1, F.lit(1))

    def taken(i: Column) -> Column:
        return F.when(i == m - 1, F.when(m == 1, F.lit(0)).otherwise(n - 1)).otherwise(
            F.floor(i * gap)
        )

    # the position whose picked row is this one is next to row / gap
    near = F.when(gap > 0, F.floor(row / gap)).otherwise(F.lit(0)).cast("long")
    bound = sized.withColumn("_m", shortest)
    options = [F.when((near + d >= 0) & (near + d < m) & (taken(near + d) == row), near + d) for d in (0, 1, -1)]
    placed = bound.withColumn("position", F.coalesce(*options)).where(F.col("position").isNotNull())
    return placed.select("model", "position", "true_label", "prediction", "anomaly_score")


def _present(models: tuple[str, ...], prefix: str) -> list[Column]:
    return [F.col(f"{prefix}_{m}") for m in models]


def _total(columns: list[Column]) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + F.coalesce(c, F.lit(0.0))
    return out


def _agreeing(models: tuple[str, ...]) -> Column:
    flags = F.array(*[F.when(F.col(f"prediction_{m}") == 1, F.lit(m)) for m in models])
    return F.filter(flags, lambda x: x.isNotNull())


def combine(
    predictions: DataFrame,
    method: str = "weighted",
    keys: tuple[str, ...] = KEYS,
    models: tuple[str, ...] = config.MODELS,
    params: config.EnsembleParams = config.EnsembleParams(),
) -> DataFrame:
    """``keys, true_label, prediction, anomaly_score, contributing_models, num_models_agree``.

    ``weighted``: weighted mean score above the threshold (an unknown model
    weighs 1/n). ``majority``: more than half of the models flag. ``cascade``:
    the first model and every later one flag; score is the maximum.
    """
    if method not in ("weighted", "majority", "cascade"):
        raise ValueError(f"unknown ensemble method {method}")
    wide = side_by_side(predictions, keys, models)
    scores, flags = _present(models, "score"), _present(models, "prediction")
    if method == "weighted":
        weights = [params.weights.get(m, 1.0 / len(models)) for m in models]
        whole = _total([F.when(s.isNotNull(), F.lit(w)) for s, w in zip(scores, weights)])
        summed = _total([s * F.lit(w) for s, w in zip(scores, weights)])
        score = F.when(whole > 0, summed / whole).otherwise(summed)
        flag = score > params.threshold
    elif method == "majority":
        voters = _total([s.isNotNull().cast("double") for s in scores])
        score = _total(scores) / voters
        flag = _total([f.cast("double") for f in flags]) / voters > 0.5
    else:
        first = "isolation_forest" if "isolation_forest" in models else models[0]
        chain = [first] + [m for m in ("deep_clustering", "lstm_autoencoder") if m in models and m != first]
        score = _widest(F.greatest, [F.col(f"score_{m}") for m in chain])
        # the first model screens: a key it did not flag, or never scored, stays clear
        later = [F.coalesce(F.col(f"prediction_{m}"), F.lit(1)) == 1 for m in chain[1:]]
        flag = reduce(lambda a, b: a & b, later, F.coalesce(F.col(f"prediction_{first}"), F.lit(0)) == 1)
    agreeing = _agreeing(models)
    return wide.select(
        *keys,
        "true_label",
        F.coalesce(flag, F.lit(False)).cast("int").alias("prediction"),
        score.alias("anomaly_score"),
        agreeing.alias("contributing_models"),
        F.size(agreeing).alias("num_models_agree"),
    )


def _widest(pick, columns: list[Column]) -> Column:
    return pick(*columns) if len(columns) > 1 else columns[0]


def as_model(ensemble: DataFrame, name: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Ensemble rows in the layout of a prediction table."""
    return ensemble.select(F.lit(name).alias("model"), *keys, "true_label", "prediction", "anomaly_score")


def best_method(comparison: DataFrame, name: str = "model", by: str = "f1_score") -> DataFrame:
    """The row with the highest ``by``; the smaller name on ties."""
    return comparison.orderBy(F.desc(by), F.asc(name)).limit(1)


def user_ensemble(
    predictions: DataFrame,
    weights: dict[str, float],
    how: str = "left",
    threshold: float | None = None,
) -> DataFrame:
    """Per-user maxima, min-maxed per model, combined with fixed weights.

    ``how`` is ``left`` (users of the base model) or ``inner`` (users of all
    models). With a threshold, ``prediction`` is 1 at or above it.
    """
    models = tuple(weights)
    wide = align_left(predictions, models=models) if how == "left" else align_inner(predictions, models=models)
    bounds = {}
    for m in models:
        bounds[f"_lo_{m}"] = F.min(f"score_{m}")
        bounds[f"_hi_{m}"] = F.max(f"score_{m}")
    found = with_group_stats(wide, [], bounds)
    parts = {m: min_max(F.col(f"score_{m}"), F.col(f"_lo_{m}"), F.col(f"_hi_{m}")) for m in models}
    score = F.lit(0.0)
    for m in models:
        score = score + parts[m] * F.lit(weights[m])
    out = found.select(
        "user",
        F.when(F.col("true_label") > 0, 1).otherwise(0).alias("true_label"),
        *[parts[m].alias(f"score_{m}") for m in models],
        score.alias("anomaly_score"),
    )
    if threshold is None:
        return out
    return out.withColumn("prediction", (F.col("anomaly_score") >= threshold).cast("int"))


def weight_choices(models: tuple[str, ...], steps: int = 10) -> list[tuple[float, ...]]:
    """All weight tuples in steps of 1/``steps`` that sum to 1, first model slowest."""

    def split(left: int, slots: int) -> list[tuple[int, ...]]:
        if slots == 1:
            return [(left,)]
        return [(i, *rest) for i in range(left + 1) for rest in split(left - i, slots - 1)]

    return [tuple(i / steps for i in choice) for choice in split(steps, len(models))]


def search_weights(
    predictions: DataFrame, models: tuple[str, ...] = ("isolation_forest", "deep_clustering", "lstm_autoencoder"), steps: int = 10
) -> DataFrame:
    """Best F1 over thresholds for every weight choice: ``choice, w_<model>, threshold, f1_score``.

    Users with equal scores are one cell, scored under all choices (66 for three models)
    at once; see ``weight_search`` for how few scores are told apart.
    """
    uniform = dict.fromkeys(models, 1.0)
    scored = user_ensemble(predictions, uniform, how="inner").drop("anomaly_score")
    scores = [f"score_{m}" for m in models]
    choices = weight_choices(models, steps)
    best = best_thresholds(score_cells(scored, scores), scores, choices)
    named = F.array(*[F.struct(*[F.lit(w).alias(f"w_{m}") for m, w in zip(models, ws)]) for ws in choices])
    return best.select("choice", F.inline(F.array(F.get(named, F.col("choice")))), "threshold", "f1_score")


def best_weights(search: DataFrame) -> DataFrame:
    """The choice with the highest F1, the earliest on ties."""
    return search.orderBy(F.desc("f1_score"), F.asc("choice")).limit(1)
