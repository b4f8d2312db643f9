"""Sequence detectors: statistical deviation and linear reconstruction."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass import config
from dayglass.detectors.thresholds import calibrate, flag_above, flag_above_quantile
from dayglass.operators.scaling import normalise
from dayglass.session import materialise

# task functions travel with their code, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_KEYS = ("user", "end_day")


def fit_deviation(train: DataFrame) -> DataFrame:
    """``position, mean, std`` for every (timestep, feature) cell of the training windows.

    Partial sums shrink each partition to length x features rows before the shuffle.
    """
    cells = train.select(F.posexplode(F.flatten("seq")).alias("position", "x"))
    return cells.groupBy("position").agg(
        F.avg("x").alias("mean"), (F.stddev_pop("x") + config.EPSILON).alias("std")
    )


def deviation_scores(windows: DataFrame, params: DataFrame) -> DataFrame:
    """Add ``anomaly_score``: mean absolute deviation in standard deviations.

    Parameters (one per cell) travel as one array, so windows are not exploded.
    """
    cells = params.agg(
        F.sort_array(F.collect_list(F.struct("position", "mean", "std"))).alias("cells")
    ).scalar()
    bound = windows.select("*", cells.alias("_cells"))
    parts = F.zip_with(
        F.flatten("seq"), F.col("_cells"), lambda x, p: F.abs(x - p["mean"]) / p["std"]
    )
    total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
    return bound.withColumn("anomaly_score", total / F.size("_cells")).drop("_cells")


def sequence_deviation(
    train: DataFrame, test: DataFrame, validation: DataFrame | None = None, target_fpr: float = 0.05
) -> DataFrame:
    """Fit on training windows, score the test windows, min-max, flag.

    With a validation set the threshold is calibrated on its own min-maxed
    scores; otherwise it is the 95th percentile of the test scores.
    """
    params = fit_deviation(train)
    kept = [*_KEYS, "label", "anomaly_score"]
    raw = materialise(deviation_scores(test, params).select(*kept), "sequence-scores")
    scored = normalise(raw, "anomaly_score")
    if validation is None:
        flagged = flag_above_quantile(scored, 0.95)
    else:
        checked = materialise(deviation_scores(validation, params).select("anomaly_score"), "sequence-normal")
        normal = normalise(checked, "anomaly_score")
        flagged = flag_above(scored, calibrate(normal, target_fpr=target_fpr))
    return _predictions(flagged)


def _predictions(flagged: DataFrame) -> DataFrame:
    return flagged.select(
        F.lit("lstm_autoencoder").alias("model"),
        "user",
        F.col("end_day").alias("day"),
        F.col("label").alias("true_label"),
        "prediction",
        "anomaly_score",
    )


def sequence_reconstruction(
    train: DataFrame,
    test: DataFrame,
    components: int = 16,
    error: str = "absolute",
    quantile: float = 0.95,
) -> DataFrame:
    """Project windows fitted on normal training windows and score what is lost.

    ``error`` is ``absolute`` (mean absolute) or ``squared``. Linear stand-in
    for a recurrent autoencoder; flags above the score's own quantile.
    """
    params = fit_deviation(train.where(F.col("label") == 0))
    cells = params.agg(
        F.sort_array(F.collect_list(F.struct("position", "mean", "std"))).alias("cells")
    ).scalar()

    def scaled(df: DataFrame) -> DataFrame:
        bound = df.select("*", cells.alias("_cells"))
        flat = F.zip_with(
            F.flatten("seq"),
            F.col("_cells"),
            # a constant cell keeps scale 1
            lambda x, p: (x - p["mean"])
            / F.when(p["std"] <= 2 * config.EPSILON, F.lit(1.0)).otherwise(p["std"]),
        )
        return bound.withColumn("_flat", flat).drop("_cells")

    normal = scaled(train.where(F.col("label") == 0))
    model = PCA(k=components, inputCol="_x", outputCol="_z").fit(
        normal.select(array_to_vector("_flat").alias("_x"))
    )
    # fitted matrix, cells x components
    basis = train.sparkSession.sparkContext.broadcast(model.pc.toArray())
    squared = error == "squared"

    @F.pandas_udf("double")
    def lost(flat: pd.Series) -> pd.Series:
        x = np.stack(flat.to_numpy())
        pc = basis.value
        left = x - (x @ pc) @ pc.T
        return pd.Series((left**2 if squared else np.abs(left)).mean(axis=1))

    scored = scaled(test).withColumn("anomaly_score", lost("_flat")).drop("_flat", "seq")
    scored = materialise(scored, "sequence-scores")
    return _predictions(flag_above_quantile(scored, quantile))


def error_summary(scored: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Mean and population standard deviation of the errors, one row."""
    return scored.agg(
        F.avg(score).alias("mean_error"), F.stddev_pop(score).alias("std_error")
    )
