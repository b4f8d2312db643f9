"""Thresholds from score quantiles and the flags they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.operators.ordering import quantiles


def calibrate(normal: DataFrame, score: str = "anomaly_score", target_fpr: float = 0.05) -> DataFrame:
    """One-row table ``threshold``: the (1 - FPR) quantile of normal validation scores."""
    return quantiles(normal, score, {"threshold": 1 - target_fpr})


def flag_above_quantile(
    df: DataFrame, quantile: float, score: str = "anomaly_score", out: str = "prediction"
) -> DataFrame:
    """1 strictly above the score's own quantile; tied top scores stay unflagged."""
    limit = quantiles(df.select(score), score, {"q": quantile}).scalar()
    return df.withColumn(out, (F.col(score) > limit).cast("int"))


def flag_above(
    df: DataFrame, threshold: DataFrame | Column | float, score: str = "anomaly_score", out: str = "prediction"
) -> DataFrame:
    limit = threshold
    if isinstance(threshold, DataFrame):
        limit = threshold.select("threshold").scalar()
    elif not isinstance(threshold, Column):
        limit = F.lit(float(threshold))
    return df.withColumn(out, (F.col(score) > limit).cast("int"))
