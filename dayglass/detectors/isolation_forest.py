"""Isolation forest (Liu, Ting and Zhou, 2008).

Samples are mergeable: every task keeps, for each tree, the rows with the lowest draws
among those it reads, and the lowest of all tasks make the tree's sample. Python sees
one Arrow batch and these bounded lists when sampling, at most ``sample_size`` rows per
tree when building, and one Arrow batch at a time when scoring.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass import config
from dayglass.operators.scaling import normalise
from dayglass.session import materialise

# task functions travel with their code, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NODES = (
    "tree int, feature array<int>, cut array<double>, "
    "left array<int>, right array<int>, path array<double>"
)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays (size bounded by trees x 2 x sample size), and the sample size used."""

    features: list[str]
    trees: list[dict]
    sample_size: int


# Increments and multipliers of the splitmix64 generator.
_GAP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _uniform(rows: np.ndarray, stream: np.ndarray | int, seed: int) -> np.ndarray:
    """Numbers in (0, 1), each a function of a row's hash, a stream and the seed."""
    with np.errstate(over="ignore"):
        x = rows.view(np.uint64) + _GAP * (np.asarray(stream).astype(np.uint64) + np.uint64(1) + (np.uint64(seed) << np.uint64(32)))
        for shift in (30, 27):
            x = (x ^ (x >> np.uint64(shift))) * _MIX[shift == 27]
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


class _Lowest:
    """The lowest draws of each tree so far: a bounded list of (draw, features) per tree."""

    def __init__(self, trees: int, size: int, limit: float, seed: int, width: int) -> None:
        self.size, self.seed, self.trees = size, seed, trees
        self.limit = np.full(trees, limit)
        self.draws = [np.empty(0)] * trees
        self.rows = [np.empty((0, width))] * trees

    def add(self, rows: np.ndarray, copies: np.ndarray, data: np.ndarray) -> None:
        """Distinct rows by hash, how many equal rows each stands for, and their features."""
        for tree in range(self.trees):
            # copies of a row draw on their own: the lowest of m numbers, then the next lowest, ...
            at, left = np.arange(len(rows)), copies.astype(float)
            draw, n = np.zeros(len(rows)), 0
            while len(at):
                step = _uniform(rows[at], tree + self.trees * n, self.seed)
                draw = draw + (1 - draw) * -np.expm1(np.log1p(-step) / left)
                near = draw <= self.limit[tree]
                at, draw, left = at[near], draw[near], left[near]
                self._keep(tree, draw, data[at])
                n += 1
                more = left > 1
                at, draw, left = at[more], draw[more], left[more] - 1

    def _keep(self, tree: int, draws: np.ndarray, data: np.ndarray) -> None:
        if not len(draws):
            return
        draws = np.concatenate([self.draws[tree], draws])
        data = np.concatenate([self.rows[tree], data])
        if len(draws) > self.size:
            lowest = np.argpartition(draws, self.size - 1)[: self.size]
            draws, data = draws[lowest], data[lowest]
            self.limit[tree] = min(self.limit[tree], draws.max())
        self.draws[tree], self.rows[tree] = draws, data


def _lowest_draws(rows: DataFrame, features: list[str], params: config.ForestParams, size: int, limit: float) -> DataFrame:
    """Per task and tree the rows with the lowest draws up to ``limit``: (``tree``, ``draw``, features)."""
    trees, seed = params.trees, params.seed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = _Lowest(trees, size, limit, seed, len(features))
        for batch in batches:
            kept.add(batch["_row"].to_numpy(), batch["_copies"].to_numpy(), batch[features].to_numpy(dtype=float))
        for tree in range(trees):
            found = pd.DataFrame(kept.rows[tree], columns=features)
            found.insert(0, "draw", kept.draws[tree])
            found.insert(0, "tree", tree)
            yield found

    return rows.mapInPandas(run, "tree int, draw double, " + ", ".join(f"`{f}` double" for f in features))


def _samples(df: DataFrame, features: list[str], key: Column, params: config.ForestParams, n: int, size: int) -> DataFrame:
    """``tree``, ``_rank`` plus features: ``size`` rows per tree without replacement, each tree drawing on its own.

    Equal rows are counted first and stand for as many draws, so each of them can be
    drawn and none is written out. A row draws by its hash: samples do not depend on the
    partitioning. Draws above a limit that the ``size``-th lowest of ``n`` stays below
    (by more than six deviations) are left out, so a few thousand rows leave the tasks;
    if a tree should come out short, the limit goes.
    """
    # features that are null count as 0 and integers as doubles, as in scoring
    row = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features], key.cast("string").alias("_key"))
    hashed = row.groupBy(F.xxhash64("_key", *features).alias("_row"))
    distinct = hashed.agg(F.count(F.lit(1)).alias("_copies"), *[F.first(f).alias(f) for f in features])
    distinct = materialise(distinct, "forest-rows")
    for limit in (min(1.0, (size + 6.0 * size**0.5 + 12.0) / n), 1.0):
        drawn = materialise(_lowest_draws(distinct, features, params, size, limit), "forest-draws")
        # at most ``trees`` rows
        full = drawn.groupBy("tree").count().where(F.col("count") >= size).count()
        if full == params.trees:
            break
    lowest = Window.partitionBy("tree").orderBy("draw", *features)
    ranked = drawn.withColumn("_rank", F.row_number().over(lowest))
    return ranked.where(F.col("_rank") <= size).select("tree", "_rank", *features)


def _tree_builder(features: list[str], seed: int, limit: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank")
        tree = int(pdf["tree"].iloc[0])
        data = pdf[features].to_numpy(dtype=float)
        draw = np.random.default_rng([seed, tree])
        feature, cut, left, right, path = [], [], [], [], []

        def grow(rows: np.ndarray, depth: int) -> int:
            node = len(feature)
            feature.append(-1), cut.append(0.0), left.append(node), right.append(node)
            path.append(depth + float(mean_path(len(rows))))
            low, high = data[rows].min(axis=0), data[rows].max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or len(open_features) == 0:
                return node
            f = int(draw.choice(open_features))
            at = float(draw.uniform(low[f], high[f]))
            goes_left = data[rows, f] <= at
            feature[node], cut[node] = f, at
            left[node] = grow(rows[goes_left], depth + 1)
            right[node] = grow(rows[~goes_left], depth + 1)
            return node

        grow(np.arange(len(data)), 0)
        return pd.DataFrame(
            {"tree": [tree], "feature": [feature], "cut": [cut], "left": [left], "right": [right], "path": [path]}
        )

    return build


def fit_forest(
    df: DataFrame, features: list[str], key: Column, params: config.ForestParams = config.ForestParams()
) -> Forest:
    """Build all trees in parallel, one small group each."""
    n = df.count()
    if n == 0:
        raise ValueError("no rows to fit on")
    size = min(params.sample_size, n)
    limit = int(np.ceil(np.log2(max(size, 2))))
    # a fixed partition count keeps small samples from being packed into one task
    samples = _samples(df, features, key, params, n, size).repartition(params.trees, "tree")
    # at most sample_size rows per tree reach one call
    built = samples.groupBy("tree").applyInPandas(_tree_builder(features, params.seed, limit), _NODES)
    # bounded by the parameters: trees x (2 x sample_size - 1) nodes
    trees = sorted((r.asDict() for r in built.collect()), key=lambda t: t["tree"])
    return Forest(list(features), trees, size)


def forest_score(df: DataFrame, forest: Forest) -> Column:
    """Raw score ``2 ** (-mean path / c(sample size))`` in (0, 1], as a column."""
    shared = df.sparkSession.sparkContext.broadcast(
        [
            (
                np.asarray(t["feature"]),
                np.asarray(t["cut"]),
                np.asarray(t["left"]),
                np.asarray(t["right"]),
                np.asarray(t["path"]),
            )
            for t in forest.trees
        ]
    )
    depth = int(np.ceil(np.log2(max(forest.sample_size, 2))))
    scale = float(mean_path(forest.sample_size)) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = shared.value
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.empty((0, 1))
            at_row = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, cut, left, right, path in trees:
                node = np.zeros(len(x), dtype=int)
                for _ in range(depth):
                    goes_left = x[at_row, feature[node]] <= cut[node]
                    node = np.where(goes_left, left[node], right[node])
                total += path[node]
            yield pd.Series(2.0 ** (-(total / len(trees)) / scale))

    return score(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in forest.features]))


def isolation_forest(
    df: DataFrame,
    features: list[str],
    keys: tuple[str, ...] = ("user", "day"),
    label: str = "is_anomaly",
    params: config.ForestParams = config.ForestParams(),
) -> DataFrame:
    """Fit on all rows and score them: score ``s - 0.5``, flagged when above 0."""
    forest = fit_forest(df, features, F.concat_ws("|", *keys), params)
    scored = df.select(*keys, _label(df, label), forest_score(df, forest).alias("_s"))
    return scored.select(
        F.lit("isolation_forest").alias("model"),
        *keys,
        "true_label",
        (F.col("_s") > 0.5).cast("int").alias("prediction"),
        (F.col("_s") - 0.5).alias("anomaly_score"),
    )


def isolation_forest_on_normals(
    train: DataFrame,
    validation: DataFrame,
    test: DataFrame,
    features: list[str],
    keys: tuple[str, ...] = ("user", "day"),
    label: str = "is_anomaly",
    target_fpr: float | None = 0.05,
    params: config.ForestParams = config.ForestParams(),
) -> DataFrame:
    """Fit on normal rows, threshold from normal validation rows, min-maxed scores.

    Without a target rate the 99th percentile of the scored rows is used.
    """
    from dayglass.detectors.thresholds import calibrate, flag_above, flag_above_quantile

    forest = fit_forest(train, features, F.concat_ws("|", *keys), params)
    scored = test.select(*keys, _label(test, label), forest_score(test, forest).alias("anomaly_score"))
    scored = materialise(scored, "forest-scores")
    if target_fpr is None:
        flagged = flag_above_quantile(scored, 0.99)
    else:
        normal = validation.select(forest_score(validation, forest).alias("anomaly_score"))
        normal = materialise(normal, "forest-normal")
        flagged = flag_above(scored, calibrate(normal, target_fpr=target_fpr))
    named = normalise(flagged, "anomaly_score").select(F.lit("isolation_forest").alias("model"), "*")
    return named.select("model", *keys, "true_label", "prediction", "anomaly_score")


def _label(df: DataFrame, label: str) -> Column:
    present = F.col(label) if label in df.columns else F.lit(0)
    return F.coalesce(present, F.lit(0)).cast("int").alias("true_label")
