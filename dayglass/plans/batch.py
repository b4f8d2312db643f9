"""The three batch jobs: logs to profiles, profiles to predictions, predictions to alerts.

Each job hands over by a written table, so a lost executor or a failed job
never costs more than its own stage.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass import config
from dayglass.detectors.isolation_forest import isolation_forest
from dayglass.detectors.latent import latent_clustering
from dayglass.detectors.sequence import sequence_reconstruction
from dayglass.operators.alerts import make_alerts
from dayglass.operators.cleaning import fill_log_defaults
from dayglass.operators.enrich import join_attributes, join_traits
from dayglass.operators.ensemble import as_model, best_method, combine
from dayglass.operators.evaluation import comparison_table, metrics
from dayglass.operators.labelling import label_events
from dayglass.operators.ordering import union_all
from dayglass.operators.profiles import daily_profile, measure_columns, static_profile
from dayglass.operators.scaling import fit_scaler
from dayglass.operators.splits import assign_split
from dayglass.operators.windows import user_series
from dayglass.sinks import writers

log = logging.getLogger(__name__)


def unify(
    logs: DataFrame,
    directory: DataFrame | None = None,
    traits: DataFrame | None = None,
    windows: DataFrame | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """Unified, enriched and labelled log from the union of all logs."""
    df = logs
    if directory is not None:
        df = join_attributes(df, directory)
    if traits is not None:
        df = join_traits(df, traits)
    return label_events(fill_log_defaults(df), windows, members)


def build_profiles(unified: DataFrame, out: str) -> dict[str, DataFrame]:
    """Daily and static profiles, the static scaler and the sequences, all written below ``out``."""
    spark = unified.sparkSession
    writers.write_profile(daily_profile(unified), f"{out}/daily")
    daily = spark.read.parquet(f"{out}/daily")
    writers.write_csv(static_profile(daily), f"{out}/static.csv")
    static = static_profile(daily)
    features = [c for c in static.columns if c != "user"]
    writers.write_params(fit_scaler(static, features), f"{out}/static_scaler")
    writers.write_sequences(user_series(daily, measure_columns(daily)), f"{out}/sequences")
    return {
        "daily": daily,
        "static": static,
        "scaler": writers.read_params(spark, f"{out}/static_scaler"),
        "sequences": writers.read_sequences(spark, f"{out}/sequences"),
    }


def run_detectors(
    daily: DataFrame,
    windows: DataFrame,
    out: str,
    models: Iterable[str] = config.MODELS,
    skip_failed: bool = False,
) -> DataFrame:
    """Predictions of all detectors as one table, in a folder of this run below ``out``.

    A detector that fails ends the run, unless ``skip_failed`` leaves it out with a log entry.
    """
    out = f"{out.rstrip('/')}/run-{uuid.uuid4().hex[:12]}"
    features = measure_columns(daily)

    def sequence_model() -> DataFrame:
        split = assign_split(windows, F.concat_ws("|", "user", "end_day"))
        return sequence_reconstruction(
            split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
        )

    jobs = {
        "isolation_forest": lambda: isolation_forest(daily, features),
        "lstm_autoencoder": sequence_model,
        "deep_clustering": lambda: latent_clustering(daily, features),
    }
    mode = "overwrite"
    for model in models:
        try:
            writers.write_predictions(jobs[model](), out, mode)
            mode = "append"
        except Exception:
            if not skip_failed:
                raise
            log.exception("%s failed and is skipped", model)
    return daily.sparkSession.read.parquet(out)


def run_ensembles(
    predictions: DataFrame, out: str, methods: Iterable[str] = ("weighted", "majority", "cascade")
) -> dict[str, DataFrame]:
    """Ensemble scores, alerts and comparison per method, and the best method by F1."""
    spark = predictions.sparkSession
    results = {}
    rows = []
    for method in methods:
        path = f"{out}/{method}"
        writers.write_profile(combine(predictions, method), f"{path}/predictions")
        scored = spark.read.parquet(f"{path}/predictions")
        named = as_model(scored, f"Ensemble ({method})")
        writers.write_profile(make_alerts(scored), f"{path}/alerts")
        writers.write_profile(comparison_table(predictions, named), f"{path}/comparison")
        results[method] = scored
        rows.append(named)
    results["best"] = best_method(metrics(union_all(rows)))
    return results


def run_all(
    spark: SparkSession, logs: DataFrame, out: str, **dimensions: DataFrame | None
) -> dict[str, DataFrame]:
    """All three jobs in turn."""
    unified = unify(logs, **dimensions)
    writers.write_unified_log(unified, f"{out}/unified")
    profiles = build_profiles(spark.read.parquet(f"{out}/unified"), f"{out}/profiles")
    predictions = run_detectors(profiles["daily"], profiles["sequences"], f"{out}/predictions")
    return profiles | run_ensembles(predictions, f"{out}/ensemble")
