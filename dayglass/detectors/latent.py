"""Latent clustering: compress, cluster, score by distance and reconstruction error.

The compression is a principal-component projection, the best linear
autoencoder; scores therefore differ from those of a non-linear network.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass import config
from dayglass.detectors.isolation_forest import _label
from dayglass.detectors.lloyd import best_centres, in_worthy_tasks
from dayglass.detectors.thresholds import calibrate, flag_above, flag_above_quantile
from dayglass.functions.numeric import min_max
from dayglass.operators.ordering import with_group_stats
from dayglass.operators.scaling import apply_scaler, fit_scaler, normalise, scale
from dayglass.session import materialise


@dataclass(frozen=True)
class LatentModel:
    features: list[str]
    pca: object
    centres: list[list[float]]


def _vector(features: list[str]) -> Column:
    return array_to_vector(
        F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    )


def project(df: DataFrame, features: list[str], components: int, out: str = "latent"):
    """Fit the projection on scaled features; returns (model, frame with array ``out``)."""
    vectors = df.withColumn("_x", _vector(features))
    model = PCA(k=components, inputCol="_x", outputCol="_z").fit(vectors.select("_x"))
    return model, _encode(df, model, features, out)


def _encode(df: DataFrame, pca, features: list[str], out: str = "latent") -> DataFrame:
    encoded = pca.transform(df.withColumn("_x", _vector(features)))
    return encoded.withColumn(out, vector_to_array("_z")).drop("_x", "_z")


def fit_latent(
    scaled: DataFrame, features: list[str], params: config.LatentParams = config.LatentParams()
) -> LatentModel:
    """Projection, then the best of ``restarts`` k-means runs by training cost.

    Up to ``max_iter`` passes go over the points, each for a round of all runs, and equal rows,
    which days of small counts mostly are, become one point that weighs as many.
    """
    components = params.components or max(1, len(features) // 2)
    rows = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    pca, _ = project(scaled, features, components)
    distinct = scaled.select(*rows).groupBy(*features).agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    stored = materialise(_encode(distinct, pca, features).select("latent", "_weight"), "latent-points")
    stored = in_worthy_tasks(stored, components)
    points = stored.select(array_to_vector("latent").alias("z"), "_weight").persist(StorageLevel.MEMORY_AND_DISK)

    def start(i: int) -> KMeans:
        # no rounds: the model's centres are where its run begins
        return KMeans(k=params.clusters, maxIter=0, seed=params.seed + i, featuresCol="z", weightCol="_weight")

    try:
        # restarts are independent jobs over the same stored points
        with ThreadPoolExecutor(params.restarts) as pool:
            begun = list(pool.map(lambda i: start(i).fit(points).clusterCenters(), range(params.restarts)))
    finally:
        points.unpersist()
    centres = best_centres(stored, [np.array(c) for c in begun], params.max_iter, start(0).getTol())
    return LatentModel(list(features), pca, centres)


def _distances(latent: str, centres: list[list[float]]) -> Column:
    """Distances to all centres (few, of few dimensions) as an array column."""

    def to(centre: list[float]) -> Column:
        parts = F.zip_with(
            F.col(latent), F.array(*[F.lit(v) for v in centre]), lambda a, b: (a - b) * (a - b)
        )
        return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v))

    return F.array(*[to(c) for c in centres])


def latent_parts(scaled: DataFrame, model: LatentModel) -> DataFrame:
    """Add ``distance`` (nearest centre, which is the row's own) and ``reconstruction_error``.

    For orthonormal components on centred input the mean squared error is
    ``(|x|^2 - |z|^2) / d``, so nothing is decoded.
    """
    encoded = _encode(scaled, model.pca, model.features)
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in model.features])
    squares = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v)
    kept = F.aggregate("latent", F.lit(0.0), lambda acc, v: acc + v * v)
    return encoded.withColumns(
        {
            "distance": F.array_min(_distances("latent", model.centres)),
            "reconstruction_error": F.greatest(squares - kept, F.lit(0.0)) / len(model.features),
        }
    )


def latent_clustering(
    df: DataFrame,
    features: list[str],
    keys: tuple[str, ...] = ("user", "day"),
    label: str = "is_anomaly",
    params: config.LatentParams = config.LatentParams(),
    scaler: DataFrame | None = None,
) -> DataFrame:
    """Half the min-maxed distance plus half the min-maxed error, flagged above p95."""
    labelled = df.select(*keys, _label(df, label), *features)
    scaled = scale(labelled, features, scaler)
    model = fit_latent(scaled, features, params)
    parts = latent_parts(scaled, model).select(*keys, "true_label", "distance", "reconstruction_error")
    parts = materialise(parts, "latent-parts")
    bounds = with_group_stats(
        parts,
        [],
        {
            "_d0": F.min("distance"),
            "_d1": F.max("distance"),
            "_e0": F.min("reconstruction_error"),
            "_e1": F.max("reconstruction_error"),
        },
    )
    distance = min_max(F.col("distance"), F.col("_d0"), F.col("_d1"))
    error = min_max(F.col("reconstruction_error"), F.col("_e0"), F.col("_e1"))
    scored = bounds.select(*keys, "true_label", (0.5 * distance + 0.5 * error).alias("anomaly_score"))
    flagged = flag_above_quantile(scored, params.quantile)
    return flagged.select(
        F.lit("deep_clustering").alias("model"), *keys, "true_label", "prediction", "anomaly_score"
    )


def latent_clustering_on_normals(
    train: DataFrame,
    validation: DataFrame,
    test: DataFrame,
    features: list[str],
    keys: tuple[str, ...] = ("user", "day"),
    label: str = "is_anomaly",
    target_fpr: float | None = 0.05,
    params: config.LatentParams = config.LatentParams(),
) -> DataFrame:
    """Fit on normals (min-max inputs), score = distance to the nearest centre.

    Without a target rate the 95th percentile of the scored rows is used.
    """
    # two numbers per feature, constants of the fitted model
    bounds = train.agg(
        *[F.min(F.col(f).cast("double")).alias(f"lo{i}") for i, f in enumerate(features)],
        *[F.max(F.col(f).cast("double")).alias(f"hi{i}") for i, f in enumerate(features)],
    ).first()

    def squeeze(df: DataFrame) -> DataFrame:
        others = [F.col(c) for c in df.columns if c not in features]
        squeezed = [
            min_max(F.col(f).cast("double"), F.lit(bounds[f"lo{i}"]), F.lit(bounds[f"hi{i}"])).alias(f)
            for i, f in enumerate(features)
        ]
        return df.select(*others, *squeezed)

    fitted_on = squeeze(train)
    centre = fit_scaler(fitted_on, features).withColumn("scale", F.lit(1.0))
    model = fit_latent(apply_scaler(fitted_on, centre, features), features, params)

    def score(df: DataFrame) -> DataFrame:
        ready = apply_scaler(squeeze(df), centre, features)
        return latent_parts(ready, model).withColumnRenamed("distance", "anomaly_score")

    scored = score(test.select(*keys, _label(test, label), *features)).select(
        *keys, "true_label", "anomaly_score"
    )
    scored = materialise(scored, "latent-scores")
    if target_fpr is None:
        flagged = flag_above_quantile(scored, 0.95)
    else:
        normal = materialise(score(validation.select(*features)).select("anomaly_score"), "latent-normal")
        flagged = flag_above(scored, calibrate(normal, target_fpr=target_fpr))
    named = normalise(flagged, "anomaly_score").select(F.lit("deep_clustering").alias("model"), "*")
    return named.select("model", *keys, "true_label", "prediction", "anomaly_score")


def projection_3d(
    df: DataFrame,
    features: list[str],
    key: Column,
    label: str = "is_insider",
    normals: int | None = None,
    components: int = 3,
) -> DataFrame:
    """Principal components of scaled features with labels; all rows, or ``normals`` sampled ones and all positives."""
    from dayglass.operators.splits import sample_normals

    scaled = scale(df, features)
    _, encoded = project(scaled, features, components)
    named = encoded.select(
        *[F.col(c) for c in df.columns if c not in features],
        *[F.col("latent")[i].alias(f"PCA{i + 1}") for i in range(components)],
    )
    return named if normals is None else sample_normals(named, key, label, normals)
