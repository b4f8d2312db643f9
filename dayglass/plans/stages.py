"""Stage tables of the test data: written once per session and input folder.

They stand where the batch jobs hand over by file. The first caller pays for
the write; readers then share a short lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.functions.numeric import min_max
from dayglass.operators.labelling import label_by_windows
from dayglass.operators.ordering import quantiles, with_group_stats
from dayglass.operators.profiles import daily_profile
from dayglass.session import scratch_path
from dayglass.sinks import writers
from dayglass.sources import adapter

_written: dict[tuple[str, str, str], str] = {}


def _stage(spark: SparkSession, sf_dir: str, name: str, write) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = scratch_path(spark, name)
        write(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def labelled_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity log with interval labels, computed in place."""
    return label_by_windows(adapter.activity_log(spark, sf_dir), adapter.incidents(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        writers.write_profile(daily_profile(labelled_log(spark, sf_dir)), path)

    return _stage(spark, sf_dir, "daily", write)


# Measure that stands in for each model's score in the test data.
STAND_INS = {
    "isolation_forest": "daily_activity_count",
    "deep_clustering": "after_hours_activity",
    "lstm_autoencoder": "unique_pcs",
}


def stand_in_predictions(profile: DataFrame) -> DataFrame:
    """Deterministic keyed scores: one min-maxed measure per model, flagged above its p95."""
    columns = list(STAND_INS.values())
    # one row of bounds
    bounds = profile.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns],
    ).first()
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                min_max(F.col(c).cast("double"), F.lit(bounds[f"lo_{c}"]), F.lit(bounds[f"hi_{c}"])).alias(
                    "anomaly_score"
                ),
            )
            for m, c in STAND_INS.items()
        ]
    )
    scored = profile.select(
        "user", "day", F.col("is_anomaly").cast("int").alias("true_label"), F.inline(entries)
    )
    limits = quantiles(scored, "anomaly_score", {"limit": 0.95}, ("model",))
    bound = with_group_stats(scored, ["model"], {"limit": F.max("limit")}, source=limits)
    return bound.select(
        "model",
        "user",
        "day",
        "true_label",
        (F.col("anomaly_score") > F.col("limit")).cast("int").alias("prediction"),
        "anomaly_score",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        writers.write_predictions(stand_in_predictions(daily(spark, sf_dir)), path)

    columns = ("model", "user", "day", "true_label", "prediction", "anomaly_score")
    return _stage(spark, sf_dir, "predictions", write).select(*columns)
