"""Whole result tables of the evaluation, ensemble and summary stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass import config
from dayglass.operators import alerts, ensemble, evaluation, ordering
from dayglass.plans import stages
from dayglass.plans.catalog_models import _ALERTS, _COUNTS, _MET, _MET4, _ORDERED, _TITLE, LOW, _summary
from dayglass.plans.catalog_profiles import rounded
from dayglass.plans.oracle_parts import METRICS, PRED, STEPS, WIDE, r, ratio
from dayglass.plans.registry import query
from dayglass.session import scratch_path
from dayglass.sinks import writers

Spark = SparkSession

METHODS = ("weighted", "majority", "cascade")

_METHOD_ROWS = {
    "weighted": "SELECT 'weighted' AS model, true_label, flag AS prediction, score AS anomaly_score FROM ens",
    "majority": """SELECT 'majority', true_label, CAST((p_if + p_seq + p_dc) / 3.0 > 0.5 AS INTEGER),
      (s_if + s_seq + s_dc) / 3.0::DOUBLE FROM wide""",
    "cascade": "SELECT 'cascade', true_label, least(p_if, p_dc, p_seq), greatest(s_if, s_dc, s_seq) FROM wide",
}


def _over(base: str, rows: str, whole: str) -> str:
    """The statement ``whole`` over other rows than the predictions."""
    return f"{base}, other AS ({rows}){whole.removeprefix(PRED).replace('FROM pred GROUP', 'FROM other GROUP')}"


_MODELS_AND_ENSEMBLE = "SELECT model, true_label, prediction, anomaly_score FROM pred UNION ALL " + _METHOD_ROWS["weighted"]


@query(
    "e4_methods_table",
    f"""WITH {_over(WIDE, ' UNION ALL '.join(_METHOD_ROWS.values()), METRICS)}
    SELECT model, {_MET}, {_COUNTS}, row_number() OVER (ORDER BY {r('f1_score', 9)} DESC, model) = 1 AS is_best FROM met""",
)
def methods_table(spark: Spark, sf_dir: str) -> DataFrame:
    """All metrics of the three ensemble methods, and which is best."""
    preds = stages.predictions(spark, sf_dir)
    rows = [ensemble.as_model(ensemble.combine(preds, m), m) for m in METHODS]
    table = evaluation.metrics(ordering.union_all(rows))
    best = ensemble.best_method(table).select("model").scalar()
    return rounded(table.withColumn("is_best", F.col("model") == best))


@query(
    "q12_comparison_with_ensemble",
    f"""WITH {_over(WIDE, _MODELS_AND_ENSEMBLE, METRICS)}
    SELECT CASE model WHEN 'weighted' THEN 'Ensemble (weighted)' ELSE {_TITLE} END AS model, {_MET4} FROM met""",
)
def comparison_with_ensemble(spark: Spark, sf_dir: str) -> DataFrame:
    """All models and the ensemble, all metrics."""
    preds = stages.predictions(spark, sf_dir)
    return evaluation.comparison_table(preds, ensemble.as_model(ensemble.combine(preds), "Ensemble (weighted)"))


@query(
    "q16_summary_comparison",
    f"""WITH {_over(WIDE, _MODELS_AND_ENSEMBLE, METRICS)}
    SELECT CASE model WHEN 'weighted' THEN 'ensemble_weighted' ELSE {_TITLE} END AS model, {_MET4} FROM met""",
)
def summary_comparison(spark: Spark, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir)["comparison"]


@query(
    "q16_summary_roc_points",
    f"""WITH {_over(WIDE, _MODELS_AND_ENSEMBLE.replace("'weighted' AS", "'ensemble_weighted' AS"), STEPS)}
    SELECT model, {r('score')} AS threshold, {r(ratio('cn', 'tot_n'))} AS fpr, {r(ratio('cp', 'tot_p'))} AS tpr FROM cum
    UNION ALL SELECT DISTINCT model, CAST('infinity' AS DOUBLE), 0.0, 0.0 FROM other""",
)
def summary_roc_points(spark: Spark, sf_dir: str) -> DataFrame:
    """Every point of all curves of the summary."""
    threshold = F.col("threshold")
    return _summary(spark, sf_dir)["roc"].select(
        "model",
        F.when(threshold == float("inf"), threshold).otherwise(F.round(threshold, 6)).alias("threshold"),
        F.round("fpr", 6).alias("fpr"),
        F.round("tpr", 6).alias("tpr"),
    )


@query(
    "q16_summary_top_alerts",
    f"""WITH {_ORDERED} SELECT alert_id, index, "user", day, {r('oa.anomaly_score')} AS anomaly_score, severity, contributing_models, num_models_agree
    FROM oa ORDER BY sr DESC, oa.anomaly_score DESC, index LIMIT 10""",
)
def summary_top_alerts(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(_summary(spark, sf_dir)["top_alerts"])


def _written(spark: Spark, sf_dir: str, name: str) -> DataFrame:
    """One table of the written ensemble outputs, read back."""
    preds = stages.predictions(spark, sf_dir)
    scored = ensemble.combine(preds)
    table = evaluation.comparison_table(preds, ensemble.as_model(scored, "Ensemble (weighted)"))
    path = scratch_path(spark, "ensemble")
    writers.write_ensemble(scored, alerts.make_alerts(scored, LOW), table, path)
    return spark.read.parquet(f"{path}/{name}")


@query(
    "k6_written_predictions",
    f"""WITH {WIDE} SELECT "user", day, true_label, flag AS prediction, {r('score')} AS anomaly_score, models AS contributing_models,
    CAST(agree AS INTEGER) AS num_models_agree FROM ens""",
)
def written_predictions(spark: Spark, sf_dir: str) -> DataFrame:
    found = _written(spark, sf_dir, "predictions")
    listed = F.concat_ws(", ", "contributing_models")
    return rounded(found.withColumn("contributing_models", listed)).select(
        "user", "day", "true_label", "prediction", "anomaly_score", "contributing_models", "num_models_agree"
    )


@query("k6_written_alerts", f"WITH {_ALERTS} SELECT * REPLACE ({r('anomaly_score')} AS anomaly_score) FROM al")
def written_alerts(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(_written(spark, sf_dir, "alerts"))


@query(
    "k6_written_comparison",
    f"""WITH {_over(WIDE, _MODELS_AND_ENSEMBLE, METRICS)}
    SELECT CASE model WHEN 'weighted' THEN 'Ensemble (weighted)' ELSE {_TITLE} END AS model, {_MET4} FROM met""",
)
def written_comparison(spark: Spark, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "comparison")


_STEPS = config.GRID_STEPS


@query(
    "q6_quantile_sweep_whole",
    f"""WITH {PRED}, th AS (SELECT DISTINCT model, round(unnest(quantile_cont(anomaly_score, [i / {_STEPS - 1}.0 FOR i IN range(0, {_STEPS})])), 9) AS t FROM pred GROUP BY model),
    vals AS (SELECT model, anomaly_score AS s, sum(true_label) AS pos, sum(1 - true_label) AS neg FROM pred GROUP BY 1, 2),
    sw AS (SELECT th.model, t, coalesce(sum(pos) FILTER (s > t + 1e-8), 0) AS tp, coalesce(sum(neg) FILTER (s > t + 1e-8), 0) AS fp,
      coalesce(sum(pos) FILTER (s <= t + 1e-8), 0) AS fn FROM th JOIN vals ON vals.model = th.model GROUP BY 1, 2)
    SELECT DISTINCT model, {r('t')} AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, {r(ratio('tp', 'tp + fp'))} AS "precision",
      {r(ratio('tp', 'tp + fn'))} AS recall, {r(ratio('2 * tp', '2 * tp + fp + fn'))} AS f1_score FROM sw""",
)
def quantile_sweep_whole(spark: Spark, sf_dir: str) -> DataFrame:
    """All quantiles of the default grid as thresholds, all columns."""
    found = evaluation.quantile_sweep(stages.predictions(spark, sf_dir))
    return rounded(found.select("model", "threshold", "tp", "fp", "fn", "precision", "recall", "f1_score")).distinct()
