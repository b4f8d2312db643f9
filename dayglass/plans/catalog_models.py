"""Queries over detectors, ensembles, alerts, evaluation and forensics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass import config
from dayglass.detectors import isolation_forest, latent, sequence, thresholds
from dayglass.operators import alerts, ensemble, evaluation, forensics, ordering, profiles, splits, windows
from dayglass.plans import stages
from dayglass.plans.catalog_profiles import (
    _LAST,
    _SEQ_FEATURES,
    _WIDTH,
    _Z,
    _PEER_SQL,
    _seq_sql,
    enriched_daily,
    rounded,
)
from dayglass.plans.oracle_parts import AUC, DAILY, LAB, METRICS, PRED, STEPS, WIDE, r, ratio
from dayglass.plans.registry import query
from dayglass.session import scratch_path
from dayglass.sinks import writers
from dayglass.sources import adapter

Spark = SparkSession

FEATURES = list(profiles.DAILY_MEASURES)


def _key():
    return F.concat_ws("|", "user", F.col("day").cast("string"))


# --- detectors --------------------------------------------------------------


@query("m4_isolation_forest")
def forest(spark: Spark, sf_dir: str) -> DataFrame:
    """50 trees over the daily profile, all rows scored."""
    return isolation_forest.isolation_forest(stages.daily(spark, sf_dir), FEATURES)


def _normal_parts(spark: Spark, sf_dir: str):
    return splits.split_normal(stages.daily(spark, sf_dir), _key(), "is_anomaly")


@query("m5_isolation_forest_on_normals")
def forest_on_normals(spark: Spark, sf_dir: str) -> DataFrame:
    train, val, test = _normal_parts(spark, sf_dir)
    return isolation_forest.isolation_forest_on_normals(train, val, test, FEATURES)


@query("m6_latent_clustering")
def latent_clusters(spark: Spark, sf_dir: str) -> DataFrame:
    return latent.latent_clustering(stages.daily(spark, sf_dir), FEATURES)


@query("m6_latent_clustering_embeddings")
def latent_embeddings(spark: Spark, sf_dir: str) -> DataFrame:
    """The same detector on 64 wide columns."""
    wide = adapter.table(spark, sf_dir, "embeddings")
    names = [f"x{i}" for i in range(64)]
    df = wide.select(
        F.col("vec_id").cast("string").alias("user"), F.lit(0).alias("day"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]
    )
    params = config.LatentParams(components=16)
    return latent.latent_clustering(df, names, params=params)


@query("m7_latent_clustering_on_normals")
def latent_on_normals(spark: Spark, sf_dir: str) -> DataFrame:
    train, val, test = _normal_parts(spark, sf_dir)
    return latent.latent_clustering_on_normals(train, val, test, FEATURES)


_U = """(('0x' || substr(md5('42' || "user" || '|' || CAST(day AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"""


@query(
    "m8_calibrated_threshold",
    f"""WITH {DAILY}, t AS (SELECT quantile_cont(CAST(daily_activity_count AS DOUBLE), 0.95) AS q FROM daily
      WHERE is_anomaly = 0 AND {_U} >= 0.8)
    SELECT "user", day, daily_activity_count AS score, {r('q')} AS threshold, CAST(daily_activity_count > q AS INTEGER) AS prediction
    FROM daily, t""",
)
def calibrated(spark: Spark, sf_dir: str) -> DataFrame:
    """95th percentile of normal validation rows, then a strict flag on all rows."""
    _, val, test = _normal_parts(spark, sf_dir)
    limit = thresholds.calibrate(val, "daily_activity_count", 0.05)
    flagged = thresholds.flag_above(test, limit, "daily_activity_count")
    return flagged.select(
        "user", "day", F.col("daily_activity_count").alias("score"), F.round(limit.select("threshold").scalar(), 6).alias("threshold"), "prediction"
    )


_DEVIATION = f"""{_seq_sql(1, _LAST)}, cells AS (
   SELECT "user", end_day, y, (t - 1) * {_WIDTH} + f AS pos, [{", ".join(f"f{i + 1}" for i in range(_WIDTH))}][f + 1] AS x
   FROM seq, range({_WIDTH}) k(f)),
 par AS (SELECT pos, avg(x) AS m, stddev_pop(x) + 1e-10 AS s FROM cells WHERE y = 0 GROUP BY 1),
 dev AS (SELECT "user", end_day, y, avg(abs(x - m) / s) AS d FROM cells JOIN par USING (pos) GROUP BY 1, 2, 3)"""


@query(
    "m9_sequence_deviation",
    f"""WITH {_DEVIATION}, b AS (SELECT min(d) AS lo, max(d) AS hi, quantile_cont(d, 0.95) AS q FROM dev)
    SELECT 'lstm_autoencoder' AS model, "user", end_day AS day, y AS true_label, CAST(d > q AS INTEGER) AS prediction,
    {r('(d - lo) / (hi - lo)')} AS anomaly_score FROM dev, b""",
)
def deviation(spark: Spark, sf_dir: str) -> DataFrame:
    """Windows scored against the cell statistics of normal windows."""
    found = windows.sequences(stages.daily(spark, sf_dir), list(_SEQ_FEATURES))
    return rounded(sequence.sequence_deviation(found.where(F.col("label") == 0), found))


@query("m10_sequence_reconstruction")
def reconstruction(spark: Spark, sf_dir: str) -> DataFrame:
    """Fitted on the training part of the windows (70 %), scored on the test part (15 %)."""
    found = windows.sequences(stages.daily(spark, sf_dir), list(_SEQ_FEATURES))
    split = splits.assign_split(found, F.concat_ws("|", "user", F.col("end_day").cast("string")))
    return sequence.sequence_reconstruction(split.where(F.col("split") == "train"), split.where(F.col("split") == "test"))


@query(
    "a20_error_summary",
    f"WITH {_DEVIATION} SELECT {r('avg(d)')} AS mean_error, {r('stddev_pop(d)')} AS std_error FROM dev",
)
def error_summary(spark: Spark, sf_dir: str) -> DataFrame:
    found = windows.sequences(stages.daily(spark, sf_dir), list(_SEQ_FEATURES))
    params = sequence.fit_deviation(found.where(F.col("label") == 0))
    return rounded(sequence.error_summary(sequence.deviation_scores(found, params)))


@query("e10_projection_3d")
def projection(spark: Spark, sf_dir: str) -> DataFrame:
    """Three components of the static profile."""
    daily = stages.daily(spark, sf_dir)
    static = profiles.static_profile(daily, measures=FEATURES)
    labelled = static.join(profiles.user_labels(daily), "user")
    features = [c for c in static.columns if c != "user"]
    return latent.projection_3d(labelled, features, F.col("user"), "is_anomaly")


# --- alignment --------------------------------------------------------------

_USER_SCORES = f"""{PRED}, us AS (SELECT model, "user", max(anomaly_score) AS score, max(true_label) AS label FROM pred GROUP BY 1, 2)"""


@query(
    "a10_user_scores",
    f"""WITH {_USER_SCORES} SELECT model, "user", {r('score')} AS score, label FROM us""",
)
def user_scores(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profiles.user_scores(stages.predictions(spark, sf_dir)))


def _partial_predictions(spark: Spark, sf_dir: str) -> DataFrame:
    """Sequence scores are missing for every third user."""
    number = F.substring("user", 2, 6).cast("int")
    return stages.predictions(spark, sf_dir).where((F.col("model") != "lstm_autoencoder") | (number % 3 != 1))


_PART = f"""{_USER_SCORES}, ps AS (SELECT * FROM us WHERE model <> 'lstm_autoencoder' OR CAST(substr("user", 2) AS INTEGER) % 3 <> 1),
 w AS (SELECT "user", max(score) FILTER (model = 'isolation_forest') AS a, max(score) FILTER (model = 'deep_clustering') AS b,
   max(score) FILTER (model = 'lstm_autoencoder') AS c, max(label) AS label FROM ps GROUP BY 1)"""


@query(
    "j9_left_alignment",
    f"""WITH {_PART} SELECT "user", label AS true_label, {r('a')} AS score_isolation_forest, {r('b')} AS score_deep_clustering,
    {r('coalesce(c, 0)')} AS score_lstm_autoencoder FROM w""",
)
def left_alignment(spark: Spark, sf_dir: str) -> DataFrame:
    wide = ensemble.align_left(_partial_predictions(spark, sf_dir))
    return rounded(wide.select("user", "true_label", *[f"score_{m}" for m in config.MODELS]))


@query(
    "j10_inner_alignment",
    f"""WITH {_PART} SELECT "user", label AS true_label, {r('a')} AS score_isolation_forest, {r('b')} AS score_deep_clustering,
    {r('c')} AS score_lstm_autoencoder FROM w WHERE c IS NOT NULL""",
)
def inner_alignment(spark: Spark, sf_dir: str) -> DataFrame:
    wide = ensemble.align_inner(_partial_predictions(spark, sf_dir))
    return rounded(wide.select("user", "true_label", *[f"score_{m}" for m in config.MODELS]))


@query(
    "j11_positional_alignment",
    f"""WITH {PRED}, pp AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY "user", day) - 1 AS i FROM pred
      WHERE model <> 'lstm_autoencoder' OR CAST(substr("user", 2) AS INTEGER) % 3 <> 1),
    c AS (SELECT model, count(*) AS n FROM pp GROUP BY 1), m AS (SELECT min(n) AS m FROM c),
    pos AS (SELECT model, p AS position, CASE WHEN p = m - 1 THEN n - 1
       ELSE CAST(floor(p * (CAST(n - 1 AS DOUBLE) / (m - 1))) AS BIGINT) END AS i FROM c, m, range(m) t(p))
    SELECT model, position, true_label, prediction, {r('anomaly_score')} AS anomaly_score FROM pos JOIN pp USING (model, i)""",
)
def positional_alignment(spark: Spark, sf_dir: str) -> DataFrame:
    """Models of unequal length thinned to the shortest by position."""
    return rounded(ensemble.align_by_position(_partial_predictions(spark, sf_dir)))


# --- ensembles --------------------------------------------------------------


def _shown(df: DataFrame) -> DataFrame:
    return rounded(
        df.select("user", "day", "true_label", "prediction", "anomaly_score", F.concat_ws(", ", "contributing_models").alias("models"), "num_models_agree")
    )


@query(
    "e1_weighted_ensemble",
    f"""WITH {WIDE} SELECT "user", day, true_label, flag AS prediction, {r('score')} AS anomaly_score, models,
    CAST(agree AS INTEGER) AS num_models_agree FROM ens""",
)
def weighted(spark: Spark, sf_dir: str) -> DataFrame:
    return _shown(ensemble.combine(stages.predictions(spark, sf_dir), "weighted"))


@query(
    "e2_majority_vote",
    f"""WITH {WIDE} SELECT "user", day, true_label, CAST((p_if + p_seq + p_dc) / 3.0 > 0.5 AS INTEGER) AS prediction,
    {r('(s_if + s_seq + s_dc) / 3.0::DOUBLE')} AS anomaly_score, models, CAST(agree AS INTEGER) AS num_models_agree FROM ens JOIN wide USING ("user", day, true_label)""",
)
def majority(spark: Spark, sf_dir: str) -> DataFrame:
    return _shown(ensemble.combine(stages.predictions(spark, sf_dir), "majority"))


@query(
    "e3_cascade",
    f"""WITH {WIDE} SELECT "user", day, true_label, least(p_if, p_dc, p_seq) AS prediction,
    {r('greatest(s_if, s_dc, s_seq)')} AS anomaly_score, models, CAST(agree AS INTEGER) AS num_models_agree FROM ens JOIN wide USING ("user", day, true_label)""",
)
def cascade(spark: Spark, sf_dir: str) -> DataFrame:
    return _shown(ensemble.combine(stages.predictions(spark, sf_dir), "cascade"))


# predictions in which the first model misses some keys and another misses others
_GAPS = f"""WITH {PRED}, kept AS (SELECT * FROM pred WHERE NOT (model = 'isolation_forest' AND day(day) % 3 = 0)
    AND NOT (model = 'deep_clustering' AND day(day) % 5 = 1)), w AS (SELECT "user", day, max(true_label) AS true_label,
    max(anomaly_score) FILTER (model = 'isolation_forest') AS s1, max(anomaly_score) FILTER (model = 'lstm_autoencoder') AS s2,
    max(anomaly_score) FILTER (model = 'deep_clustering') AS s3, max(prediction) FILTER (model = 'isolation_forest') AS p1,
    max(prediction) FILTER (model = 'lstm_autoencoder') AS p2, max(prediction) FILTER (model = 'deep_clustering') AS p3
    FROM kept GROUP BY 1, 2),
    e AS (SELECT *, (CASE WHEN s1 IS NULL THEN 0 ELSE 0.3 END + CASE WHEN s2 IS NULL THEN 0 ELSE 0.4 END
      + CASE WHEN s3 IS NULL THEN 0 ELSE 0.3 END)::DOUBLE AS whole,
      coalesce(s1, 0) * 0.3::DOUBLE + coalesce(s2, 0) * 0.4::DOUBLE + coalesce(s3, 0) * 0.3::DOUBLE AS summed,
      CAST(p1 IS NOT NULL AS INTEGER) + CAST(p2 IS NOT NULL AS INTEGER) + CAST(p3 IS NOT NULL AS INTEGER) AS voters,
      coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0) AS votes FROM w)"""


def _with_gaps(spark: Spark, sf_dir: str) -> DataFrame:
    date = F.dayofmonth("day")
    gap = ((F.col("model") == "isolation_forest") & (date % 3 == 0)) | ((F.col("model") == "deep_clustering") & (date % 5 == 1))
    return stages.predictions(spark, sf_dir).where(~gap)


@query(
    "e1_weighted_partial",
    f"""{_GAPS} SELECT "user", day, true_label, CAST(summed / whole > 0.7 AS INTEGER) AS prediction,
    {r('summed / whole')} AS anomaly_score FROM e""",
)
def weighted_partial(spark: Spark, sf_dir: str) -> DataFrame:
    """Keys that lack a model share the weights of those they have."""
    found = rounded(ensemble.combine(_with_gaps(spark, sf_dir), "weighted"))
    return found.select("user", "day", "true_label", "prediction", "anomaly_score")


@query(
    "e2_majority_partial",
    f"""{_GAPS} SELECT "user", day, true_label, CAST(votes / voters > 0.5 AS INTEGER) AS prediction,
    {r('(coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0)) / voters::DOUBLE')} AS anomaly_score FROM e""",
)
def majority_partial(spark: Spark, sf_dir: str) -> DataFrame:
    """Present models vote."""
    found = rounded(ensemble.combine(_with_gaps(spark, sf_dir), "majority"))
    return found.select("user", "day", "true_label", "prediction", "anomaly_score")


@query(
    "e3_cascade_partial",
    f"""{_GAPS} SELECT "user", day, true_label,
    CAST(coalesce(p1, 0) = 1 AND coalesce(p2, 1) = 1 AND coalesce(p3, 1) = 1 AS INTEGER) AS prediction,
    {r('greatest(s1, s2, s3)')} AS anomaly_score FROM e""",
)
def cascade_partial(spark: Spark, sf_dir: str) -> DataFrame:
    """A key that the first model never scored stays clear."""
    found = rounded(ensemble.combine(_with_gaps(spark, sf_dir), "cascade"))
    return found.select("user", "day", "true_label", "prediction", "anomaly_score")


_ENS_PRED = f"""{WIDE}, methods AS (
  SELECT 'cascade' AS model, true_label, least(p_if, p_dc, p_seq) AS prediction FROM wide UNION ALL
  SELECT 'majority', true_label, CAST((p_if + p_seq + p_dc) / 3.0 > 0.5 AS INTEGER) FROM wide UNION ALL
  SELECT 'weighted', true_label, flag FROM ens),
 mc AS (SELECT model, count(*) FILTER (true_label = 1 AND prediction = 1) AS tp, count(*) FILTER (true_label = 0 AND prediction = 1) AS fp,
   count(*) FILTER (true_label = 1 AND prediction = 0) AS fn FROM methods GROUP BY 1)"""


@query(
    "e4_best_method",
    f"""WITH {_ENS_PRED} SELECT model, {r(ratio('2 * tp', '2 * tp + fp + fn'))} AS f1_score FROM mc
    ORDER BY f1_score DESC, model LIMIT 1""",
)
def best_method(spark: Spark, sf_dir: str) -> DataFrame:
    preds = stages.predictions(spark, sf_dir)
    rows = [ensemble.as_model(ensemble.combine(preds, m), m) for m in ("weighted", "majority", "cascade")]
    table = evaluation.metrics(ordering.union_all(rows))
    return rounded(ensemble.best_method(table).select("model", "f1_score"))


_NORM = """nb AS (SELECT *, CASE WHEN max(a) OVER () - min(a) OVER () < 1e-10 THEN 0 ELSE (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) END AS na,
   CASE WHEN max(b) OVER () - min(b) OVER () < 1e-10 THEN 0 ELSE (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) END AS nbb,
   CASE WHEN max(c) OVER () - min(c) OVER () < 1e-10 THEN 0 ELSE (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) END AS nc FROM {})"""


@query(
    "e5_user_ensemble",
    f"""WITH {_PART}, w0 AS (SELECT "user", label, a, b, coalesce(c, 0) AS c FROM w), {_NORM.format('w0')}
    SELECT "user", CAST(label > 0 AS INTEGER) AS true_label, {r('na * 0.4::DOUBLE + nbb * 0.2::DOUBLE + nc * 0.4::DOUBLE')} AS anomaly_score FROM nb""",
)
def user_ensemble(spark: Spark, sf_dir: str) -> DataFrame:
    found = ensemble.user_ensemble(_partial_predictions(spark, sf_dir), config.USER_WEIGHTS, "left")
    return rounded(found.select("user", "true_label", "anomaly_score"))


@query(
    "e6_final_ensemble",
    f"""WITH {_PART}, w0 AS (SELECT "user", label, a, b, c FROM w WHERE c IS NOT NULL), {_NORM.format('w0')}
    SELECT "user", CAST(label > 0 AS INTEGER) AS true_label, {r('na * 0.1::DOUBLE + nbb * 0.1::DOUBLE + nc * 0.8::DOUBLE')} AS anomaly_score,
    CAST(na * 0.1::DOUBLE + nbb * 0.1::DOUBLE + nc * 0.8::DOUBLE >= 0.85 AS INTEGER) AS prediction FROM nb""",
)
def final_ensemble(spark: Spark, sf_dir: str) -> DataFrame:
    found = ensemble.user_ensemble(
        _partial_predictions(spark, sf_dir), config.FINAL_WEIGHTS, "inner", config.FINAL_THRESHOLD
    )
    return rounded(found.select("user", "true_label", "anomaly_score", "prediction"))


_GRID = f"""{_PART}, w0 AS (SELECT "user", label, a, b, c FROM w WHERE c IS NOT NULL), {_NORM.format('w0')},
 ch AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS choice, i / 10.0::DOUBLE AS w1, j / 10.0::DOUBLE AS w2, (10 - i - j) / 10.0::DOUBLE AS w3
   FROM range(11) x(i), range(11) y(j) WHERE i + j <= 10),
 sc AS (SELECT choice, w1, w2, w3, 0.0::DOUBLE + na * w1 + nbb * w2 + nc * w3 AS s, CAST(label > 0 AS INTEGER) AS y FROM nb, ch),
 st AS (SELECT choice, w1, w2, w3, s, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY 1, 2, 3, 4, 5),
 cu AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY choice) AS tp_all FROM st
   WINDOW w AS (PARTITION BY choice ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT *, {ratio('2 * cp', 'tp_all + cp + cn')} AS f1 FROM cu),
 rk AS (SELECT *, row_number() OVER (PARTITION BY choice ORDER BY f1 DESC, s) AS k FROM f)"""


@query(
    "e7_weight_search",
    f"""WITH {_GRID} SELECT CAST(choice AS INTEGER) AS choice, w1 AS w_isolation_forest, w2 AS w_deep_clustering, w3 AS w_lstm_autoencoder,
    {r('s')} AS threshold, {r('f1')} AS f1_score FROM rk WHERE k = 1""",
)
def weight_search(spark: Spark, sf_dir: str) -> DataFrame:
    """Best F1 for each of the 66 weight choices."""
    return rounded(ensemble.search_weights(_partial_predictions(spark, sf_dir)), skip=("w_isolation_forest", "w_deep_clustering", "w_lstm_autoencoder"))


@query(
    "e7_best_weights",
    f"""WITH {_GRID} SELECT w1 AS w_isolation_forest, w2 AS w_deep_clustering, w3 AS w_lstm_autoencoder, {r('f1')} AS f1_score
    FROM rk WHERE k = 1 ORDER BY f1 DESC, choice LIMIT 1""",
)
def best_weights(spark: Spark, sf_dir: str) -> DataFrame:
    best = ensemble.best_weights(ensemble.search_weights(_partial_predictions(spark, sf_dir)))
    return best.select("w_isolation_forest", "w_deep_clustering", "w_lstm_autoencoder", F.round("f1_score", 6).alias("f1_score"))


# --- alerts -----------------------------------------------------------------

LOW = 0.45  # a lowered threshold, so that the stand-in scores raise alerts

_ALERTS = f"""{WIDE}, num AS (SELECT *, row_number() OVER (ORDER BY "user", day) - 1 AS idx FROM ens),
 al AS (SELECT 'ALERT_' || CASE WHEN length(CAST(idx AS VARCHAR)) < 6 THEN lpad(CAST(idx AS VARCHAR), 6, '0') ELSE CAST(idx AS VARCHAR) END AS alert_id,
   idx AS index, "user", day, score AS anomaly_score,
   CASE WHEN score BETWEEN 0.7 AND 0.8 THEN 'low' WHEN score BETWEEN 0.8 AND 0.9 THEN 'medium'
     WHEN score BETWEEN 0.9 AND 0.98 THEN 'high' WHEN score BETWEEN 0.98 AND 1.0 THEN 'critical' ELSE 'low' END AS severity,
   models AS contributing_models, CAST(agree AS INTEGER) AS num_models_agree FROM num WHERE score > {LOW})"""
_ORDERED = f"""{_ALERTS}, oa AS (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS sr FROM al)"""


def _alerts(spark: Spark, sf_dir: str, numbered: bool = True) -> DataFrame:
    return alerts.make_alerts(ensemble.combine(stages.predictions(spark, sf_dir)), LOW, numbered=numbered)


@query("e8_alerts", f"WITH {_ALERTS} SELECT * REPLACE ({r('anomaly_score')} AS anomaly_score) FROM al")
def make_alerts(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(_alerts(spark, sf_dir))


@query("e9_severity_counts", f"WITH {_ALERTS} SELECT severity, count(*) AS alerts, {r('100.0 * count(*) / sum(count(*)) OVER ()')} AS share_pct FROM al GROUP BY 1")
def severity_counts(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(alerts.severity_counts(_alerts(spark, sf_dir, numbered=False)))


@query("e9_model_agreement", f"WITH {_ALERTS} SELECT num_models_agree, count(*) AS alerts FROM al GROUP BY 1")
def agreement(spark: Spark, sf_dir: str) -> DataFrame:
    return alerts.agreement_counts(_alerts(spark, sf_dir, numbered=False))


@query(
    "r2_ordered_alerts",
    f"""WITH {_ORDERED} SELECT row_number() OVER (ORDER BY sr DESC, anomaly_score DESC, index) AS place, alert_id, severity FROM oa""",
)
def ordered_alerts(spark: Spark, sf_dir: str) -> DataFrame:
    """Alerts numbered in order of severity, score and position."""
    found = _alerts(spark, sf_dir)
    order = [-alerts.severity_rank(F.col("severity")), -F.col("anomaly_score"), F.col("index")]
    return ordering.row_numbers(found, order, out="place").select("place", "alert_id", "severity")


@query(
    "r3_top_alerts",
    f"""WITH {_ORDERED} SELECT alert_id, severity, {r('anomaly_score')} AS anomaly_score FROM oa
    ORDER BY sr DESC, oa.anomaly_score DESC, index LIMIT 10""",
)
def top_alerts(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(alerts.top_alerts(_alerts(spark, sf_dir), 10).select("alert_id", "severity", "anomaly_score"))


@query(
    "k6_ensemble_outputs",
    f"""WITH {_ALERTS} SELECT 'alerts' AS output, count(*) AS n FROM al UNION ALL SELECT 'predictions', count(*) FROM ens
    UNION ALL SELECT 'comparison', 4""",
)
def ensemble_sink(spark: Spark, sf_dir: str) -> DataFrame:
    preds = stages.predictions(spark, sf_dir)
    scored = ensemble.combine(preds)
    table = evaluation.comparison_table(preds, ensemble.as_model(scored, "Ensemble (weighted)"))
    path = scratch_path(spark, "ensemble")
    writers.write_ensemble(scored, alerts.make_alerts(scored, LOW), table, path)
    return ordering.union_all(
        [
            spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("output"), F.count(F.lit(1)).alias("n"))
            for n in ("alerts", "predictions", "comparison")
        ]
    )


# --- evaluation -------------------------------------------------------------

_MET = ", ".join(f"{r(c)} AS {c}" for c in ("accuracy", '"precision"', "recall", "f1_score", "auc_roc"))
_COUNTS = "tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives"


@query("q1_metrics", f"WITH {METRICS} SELECT model, {_MET}, {_COUNTS} FROM met")
def metrics(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.metrics(stages.predictions(spark, sf_dir)))


@query(
    "q2_roc_points",
    f"""WITH {STEPS} SELECT model, {r('score')} AS threshold, {r(ratio('cn', 'tot_n'))} AS fpr, {r(ratio('cp', 'tot_p'))} AS tpr FROM cum
    UNION ALL SELECT DISTINCT model, CAST('infinity' AS DOUBLE), 0.0, 0.0 FROM pred""",
)
def roc(spark: Spark, sf_dir: str) -> DataFrame:
    points = evaluation.roc_points(stages.predictions(spark, sf_dir))
    return points.select(
        "model",
        F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(F.round("threshold", 6)).alias("threshold"),
        F.round("fpr", 6).alias("fpr"),
        F.round("tpr", 6).alias("tpr"),
    )


@query("q2_auc", f"WITH {AUC} SELECT model, {r('auc_roc')} AS auc_roc FROM auc")
def auc(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.auc_roc(stages.predictions(spark, sf_dir)))


@query(
    "q3_pr_points",
    f"""WITH {STEPS} SELECT model, {r('score')} AS threshold, {r(ratio('cp', 'cp + cn'))} AS "precision", {r(ratio('cp', 'tot_p'))} AS recall FROM cum
    UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM pred""",
)
def pr(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.pr_points(stages.predictions(spark, sf_dir)))


@query(
    "q3_pr_summary",
    f"""WITH {STEPS}, pp AS (SELECT *, {ratio('cp', 'cp + cn')} AS p, {ratio('pos', 'tot_p')} AS g FROM cum),
    lagged AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY model ORDER BY score DESC), 1.0) AS before FROM pp)
    SELECT model, {r('sum(g * p)')} AS average_precision, {r('sum(g * (p + before) / 2.0)')} AS pr_auc FROM lagged GROUP BY 1""",
)
def pr_summary(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.pr_summary(stages.predictions(spark, sf_dir)))


@query(
    "q4_confusion",
    f"""WITH {PRED}, cells AS (SELECT model, y, p FROM (SELECT DISTINCT model FROM pred), (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(p))
    SELECT cells.model, CAST(y AS INTEGER) AS true_label, CAST(p AS INTEGER) AS prediction, count(pred.model) AS n FROM cells
    LEFT JOIN pred ON pred.model = cells.model AND true_label = y AND prediction = p GROUP BY 1, 2, 3""",
)
def confusion(spark: Spark, sf_dir: str) -> DataFrame:
    return evaluation.confusion(stages.predictions(spark, sf_dir))


def _sweep_sql(low: str, high: str, steps: int = 100) -> str:
    last = steps - 1
    return f"""{PRED}, bd AS (SELECT model, {low} AS lo, {high} AS hi FROM pred GROUP BY 1),
 th AS (SELECT model, i AS step, CASE WHEN i = {last} THEN hi ELSE lo + i * ((hi - lo) / {last}) END AS t FROM bd, range({steps}) x(i)),
 sw AS (SELECT th.model, step, t, count(*) FILTER (anomaly_score > t AND true_label = 1) AS tp,
   count(*) FILTER (anomaly_score > t AND true_label = 0) AS fp, count(*) FILTER (anomaly_score <= t AND true_label = 1) AS fn
   FROM th JOIN pred ON pred.model = th.model GROUP BY 1, 2, 3),
 swm AS (SELECT *, {ratio('tp', 'tp + fp')} AS p, {ratio('tp', 'tp + fn')} AS r, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM sw),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, step) AS k FROM swm) WHERE k = 1)"""


_OWN = _sweep_sql("min(anomaly_score)", "max(anomaly_score)")


@query(
    "q5_threshold_sweep",
    f"""WITH {_OWN} SELECT model, step, {r('t')} AS threshold, {r('p')} AS "precision", {r('r')} AS recall, {r('f1')} AS f1_score, tp, fp, fn FROM swm""",
)
def sweep(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.threshold_sweep(stages.predictions(spark, sf_dir)))


@query(
    "q5_best_threshold",
    f"""WITH {_OWN} SELECT model, {r('t')} AS threshold, {r('f1')} AS f1_score, {r('p')} AS "precision", {r('r')} AS recall FROM best WHERE f1 > 0""",
)
def best_threshold(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.best_threshold(evaluation.threshold_sweep(stages.predictions(spark, sf_dir))))


@query(
    "q6_candidate_sweep",
    f"""WITH {PRED}, th AS (SELECT DISTINCT model, anomaly_score AS t FROM pred),
    sw AS (SELECT th.model, t, count(*) FILTER (anomaly_score > t AND true_label = 1) AS tp, count(*) FILTER (anomaly_score > t AND true_label = 0) AS fp,
      count(*) FILTER (anomaly_score <= t AND true_label = 1) AS fn FROM th JOIN pred ON pred.model = th.model GROUP BY 1, 2)
    SELECT model, {r('t')} AS threshold, {r(ratio('tp', 'tp + fp'))} AS "precision", {r(ratio('tp', 'tp + fn'))} AS recall,
    {r(ratio('2 * tp', '2 * tp + fp + fn'))} AS f1_score FROM sw""",
)
def candidates(spark: Spark, sf_dir: str) -> DataFrame:
    """Every distinct score as a threshold."""
    found = evaluation.candidate_sweep(stages.predictions(spark, sf_dir))
    return rounded(found.select("model", "threshold", "precision", "recall", "f1_score"))


@query(
    "q6_quantile_sweep",
    f"""WITH {PRED}, th AS (SELECT DISTINCT model, unnest(quantile_cont(anomaly_score, [i / 49.0 FOR i IN range(0, 50)])) AS t FROM pred GROUP BY model),
    sw AS (SELECT th.model, t, count(*) FILTER (anomaly_score > t + 1e-9 AND true_label = 1) AS tp, count(*) FILTER (anomaly_score > t + 1e-9 AND true_label = 0) AS fp,
      count(*) FILTER (anomaly_score <= t + 1e-9 AND true_label = 1) AS fn FROM th JOIN pred ON pred.model = th.model GROUP BY 1, 2)
    SELECT model, {r('t')} AS threshold, tp, fp, fn FROM sw""",
)
def quantile_candidates(spark: Spark, sf_dir: str) -> DataFrame:
    """Fifty evenly spaced quantiles of each model's scores as thresholds."""
    found = evaluation.quantile_sweep(stages.predictions(spark, sf_dir), 50)
    return rounded(found.select("model", "threshold", "tp", "fp", "fn")).distinct()


@query(
    "q7_full_recall_threshold",
    f"""WITH {PRED}, t AS (SELECT model, min(anomaly_score) FILTER (true_label = 1) AS t FROM pred GROUP BY 1),
    c AS (SELECT pred.model, t, count(*) FILTER (anomaly_score < t AND true_label = 0) AS tn, count(*) FILTER (anomaly_score >= t AND true_label = 0) AS fp,
      count(*) FILTER (anomaly_score < t AND true_label = 1) AS fn, count(*) FILTER (anomaly_score >= t AND true_label = 1) AS tp
      FROM pred JOIN t USING (model) GROUP BY 1, 2)
    SELECT model, {r('t')} AS threshold, {r(ratio('tp', 'tp + fp'))} AS "precision", {r(ratio('tp', 'tp + fn'))} AS recall,
    {r(ratio('2 * tp', '2 * tp + fp + fn'))} AS f1_score, {r(ratio('tp + tn', 'tp + tn + fp + fn'))} AS accuracy, tn, fp, fn, tp FROM c""",
)
def full_recall(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.full_recall_threshold(stages.predictions(spark, sf_dir)))


_FIXED = _sweep_sql("CAST(0.4 AS DOUBLE)", "CAST(0.9 AS DOUBLE)")


@query(
    "q8_recalibrated_predictions",
    f"""WITH {_FIXED} SELECT pred.model, "user", day, {r('CASE WHEN f1 > 0 THEN t ELSE 0.5 END')} AS threshold,
    CAST(anomaly_score > CASE WHEN f1 > 0 THEN t ELSE 0.5 END AS INTEGER) AS prediction FROM pred JOIN best USING (model)""",
)
def recalibrated(spark: Spark, sf_dir: str) -> DataFrame:
    """Sweep over a fixed range and new predictions under the best threshold."""
    found = evaluation.recalibrate(stages.predictions(spark, sf_dir), 0.4, 0.9)
    return rounded(found.select("model", "user", "day", "threshold", "prediction"))


@query(
    "k10_rewritten_predictions",
    f"""WITH {_FIXED} SELECT pred.model, count(*) AS n, CAST(sum(CAST(anomaly_score > CASE WHEN f1 > 0 THEN t ELSE 0.5 END AS INTEGER)) AS BIGINT) AS flagged
    FROM pred JOIN best USING (model) GROUP BY 1""",
)
def rewritten(spark: Spark, sf_dir: str) -> DataFrame:
    """New version of the prediction table under recalibrated thresholds."""
    preds = stages.predictions(spark, sf_dir)
    base = scratch_path(spark, "versions")
    best = evaluation.best_threshold(evaluation.threshold_sweep(preds, low=0.4, high=0.9), 0.5)
    path = writers.rewrite_predictions(preds, base, best)
    return spark.read.parquet(path).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("prediction").cast("long").alias("flagged")
    )


@query(
    "q9_best_f1_on_curve",
    f"""WITH {STEPS}, f AS (SELECT *, {ratio('2 * cp', 'tot_p + cp + cn')} AS f1 FROM cum),
    k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) AS k FROM f)
    SELECT model, {r('score')} AS threshold, {r(ratio('cp', 'cp + cn'))} AS "precision", {r(ratio('cp', 'tot_p'))} AS recall, {r('f1')} AS f1_score FROM k WHERE k = 1""",
)
def best_f1(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.best_f1_on_curve(stages.predictions(spark, sf_dir)))


_RANKED = f"""{PRED}, rkd AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY anomaly_score DESC, "user", day) AS rank,
   count(*) OVER (PARTITION BY model) AS n_all, sum(true_label) OVER (PARTITION BY model) AS p_all FROM pred)"""
_AT_K = f"""{_RANKED}, atk AS (SELECT model, k, sum(CASE WHEN rank <= k THEN true_label ELSE 0 END) AS h, max(n_all) AS n_all, max(p_all) AS p_all
   FROM rkd, (VALUES (10), (50), (100), (500)) x(k) GROUP BY 1, 2)"""


@query(
    "q10_precision_at_k",
    f"""WITH {_AT_K} SELECT model, CAST(k AS INTEGER) AS k, {r('h / k::DOUBLE')} AS precision_at_k, {r(ratio('h', 'p_all'))} AS recall_at_k
    FROM atk WHERE k <= n_all""",
)
def at_k(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.precision_at_k(stages.predictions(spark, sf_dir)))


_AT_FPR = """fl AS (SELECT model, v AS max_fpr, greatest(0.0, coalesce(max(CASE WHEN tot_p = 0 THEN 0 ELSE cp / tot_p END) FILTER (cn / tot_n <= v), 0.0)) AS recall
   FROM cum, (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) x(v) GROUP BY 1, 2)"""


@query("q11_recall_at_fpr", f"WITH {STEPS}, {_AT_FPR} SELECT model, max_fpr, {r('recall')} AS recall FROM fl")
def at_fpr(spark: Spark, sf_dir: str) -> DataFrame:
    found = evaluation.recall_at_fpr(stages.predictions(spark, sf_dir))
    return found.select("model", "max_fpr", F.round("recall", 6).alias("recall"))


@query(
    "w5_positive_ranks",
    f"""WITH {_RANKED} SELECT model, "user", day, rank, {r('100.0 * rank / n_all')} AS top_pct FROM rkd WHERE true_label = 1""",
)
def ranks(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.positive_ranks(stages.predictions(spark, sf_dir)).drop("anomaly_score"))


@query(
    "w5_rank_summary",
    f"""WITH {_RANKED} SELECT model, min(rank) AS best_rank, max(rank) AS worst_rank, {r('avg(rank)')} AS avg_rank FROM rkd WHERE true_label = 1 GROUP BY 1""",
)
def rank_summary(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.rank_summary(stages.predictions(spark, sf_dir)))


_TITLE = """CASE model WHEN 'isolation_forest' THEN 'Isolation Forest' WHEN 'deep_clustering' THEN 'Deep Clustering'
   WHEN 'lstm_autoencoder' THEN 'Lstm Autoencoder' ELSE model END"""
_MET4 = ", ".join(f"{r(c, 4)} AS {c}" for c in ("accuracy", '"precision"', "recall", "f1_score", "auc_roc"))


@query("q12_comparison_table", f"WITH {METRICS} SELECT {_TITLE} AS model, {_MET4} FROM met")
def comparison(spark: Spark, sf_dir: str) -> DataFrame:
    return evaluation.comparison_table(stages.predictions(spark, sf_dir))


@query(
    "k8_evaluation_report",
    f"""WITH {METRICS} SELECT {_TITLE} AS model, {_MET4}, row_number() OVER (ORDER BY {r('f1_score', 4)} DESC, {_TITLE}) = 1 AS is_best FROM met""",
)
def report(spark: Spark, sf_dir: str) -> DataFrame:
    return evaluation.evaluation_report(stages.predictions(spark, sf_dir))


@query(
    "q12_with_ensemble_row",
    f"""WITH {_ENS_PRED} SELECT 'Ensemble (weighted)' AS model, {r(ratio('2 * tp', '2 * tp + fp + fn'), 4)} AS f1_score FROM mc WHERE model = 'weighted'""",
)
def ensemble_row(spark: Spark, sf_dir: str) -> DataFrame:
    preds = stages.predictions(spark, sf_dir)
    extra = ensemble.as_model(ensemble.combine(preds), "Ensemble (weighted)")
    return evaluation.comparison_table(preds, extra).where(F.col("model") == "Ensemble (weighted)").select("model", "f1_score")


@query(
    "q13_imbalance_table",
    f"""WITH {AUC}, {_AT_FPR}, rkd AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY anomaly_score DESC, "user", day) AS rank FROM pred),
    g AS (SELECT model, count(*) AS n, sum(true_label) AS p, sum(true_label) FILTER (rank <= 50) AS h50, sum(true_label) FILTER (rank <= 100) AS h100,
      min(rank) FILTER (true_label = 1) AS br, max(rank) FILTER (true_label = 1) AS wr, avg(rank) FILTER (true_label = 1) AS ar FROM rkd GROUP BY 1)
    SELECT {_TITLE.replace('model', 'g.model')} AS model, n AS n_samples, CAST(p AS BIGINT) AS n_insiders, '1:' || CAST(CAST(floor(n / p) AS BIGINT) AS VARCHAR) AS imbalance_ratio,
    {r('auc_roc')} AS auc_roc, {r('h50 / 50.0')} AS precision_at_50, {r('h100 / 100.0')} AS precision_at_100,
    {r('(SELECT recall FROM fl WHERE fl.model = g.model AND max_fpr = 0.05)')} AS recall_at_5pct_fpr,
    {r('(SELECT recall FROM fl WHERE fl.model = g.model AND max_fpr = 0.1)')} AS recall_at_10pct_fpr,
    br AS best_rank, wr AS worst_rank, {r('ar')} AS avg_rank FROM g JOIN auc ON auc.model = g.model""",
)
def imbalance(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.imbalance_table(stages.predictions(spark, sf_dir)))


@query(
    "q14_health_check",
    f"""WITH {PRED} SELECT model, count(*) AS n, CAST(sum(true_label) AS BIGINT) AS positive_labels, {r('100.0 * sum(true_label) / count(*)')} AS label_pct,
    CAST(sum(prediction) AS BIGINT) AS positive_predictions, {r('100.0 * sum(prediction) / count(*)')} AS prediction_pct,
    sum(true_label) = 0 AS no_positive_labels, sum(prediction) = 0 AS no_positive_predictions, stddev_pop(anomaly_score) < 0.01 AS scores_nearly_equal
    FROM pred GROUP BY 1""",
)
def health(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.health_check(stages.predictions(spark, sf_dir)))


@query(
    "q15_scored_positives",
    f"""WITH {_PART} SELECT "user", label AS true_label, {r('a')} AS score_isolation_forest, {r('b')} AS score_deep_clustering, {r('c')} AS score_lstm_autoencoder
    FROM w WHERE c IS NOT NULL AND label > 0""",
)
def positives(spark: Spark, sf_dir: str) -> DataFrame:
    """Positive users with every model's score."""
    found = forensics.scored_positives(ensemble.align_inner(_partial_predictions(spark, sf_dir)))
    return rounded(found.select("user", "true_label", *[f"score_{m}" for m in config.MODELS]))


def _summary(spark: Spark, sf_dir: str) -> dict[str, DataFrame]:
    preds = stages.predictions(spark, sf_dir)
    scored = ensemble.combine(preds)
    return evaluation.executive_summary(preds, ensemble.as_model(scored, "ensemble_weighted"), alerts.make_alerts(scored, LOW))


@query(
    "q16_summary_severity",
    f"WITH {_ALERTS} SELECT severity, count(*) AS alerts, {r('100.0 * count(*) / sum(count(*)) OVER ()')} AS share_pct FROM al GROUP BY 1",
)
def summary_severity(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(_summary(spark, sf_dir)["severity"])


@query(
    "q16_summary_roc",
    f"""WITH {WIDE}, al AS (SELECT model, true_label, anomaly_score FROM pred UNION ALL SELECT 'ensemble_weighted', true_label, score FROM ens),
    st AS (SELECT model, anomaly_score AS s, sum(true_label)::DOUBLE AS pos, sum(1 - true_label)::DOUBLE AS neg FROM al GROUP BY 1, 2),
    cu AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model) AS tp, sum(neg) OVER (PARTITION BY model) AS tn FROM st
      WINDOW w AS (PARTITION BY model ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
    SELECT model, count(*) + 1 AS points, {r(f"sum({ratio('cp', 'tp')})", 4)} AS sum_tpr, {r(f"sum({ratio('cn', 'tn')})", 4)} AS sum_fpr FROM cu GROUP BY 1""",
)
def summary_roc(spark: Spark, sf_dir: str) -> DataFrame:
    """ROC points of models and ensemble, digested per model."""
    points = _summary(spark, sf_dir)["roc"]
    return rounded(
        points.groupBy("model").agg(
            F.count(F.lit(1)).alias("points"), F.sum("tpr").alias("sum_tpr"), F.sum("fpr").alias("sum_fpr")
        ),
        4,
    )


# --- counts and distributions ----------------------------------------------


@query("a14_value_counts", f"WITH {LAB} SELECT activity, count(*) AS n FROM lab WHERE activity IS NOT NULL GROUP BY 1")
def value_counts(spark: Spark, sf_dir: str) -> DataFrame:
    return evaluation.value_counts(adapter.activity_log(spark, sf_dir), "activity")


@query(
    "a15_labelled_users",
    f"""WITH {LAB}, k AS (SELECT user_id, activity_type, count(*) AS n FROM lab WHERE is_insider = 1 GROUP BY 1, 2)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS records, string_agg(activity_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY activity_type) AS by_type FROM k GROUP BY 1""",
)
def labelled_users(spark: Spark, sf_dir: str) -> DataFrame:
    """Labelled events per user and kind, the map shown as text."""
    found = evaluation.labelled_user_breakdown(stages.labelled_log(spark, sf_dir))
    entries = F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("user_id", "records", F.concat_ws(",", entries).alias("by_type"))


@query(
    "a16_class_balance",
    f"""WITH {LAB}, c AS (SELECT count(*) AS t, count(*) FILTER (is_insider = 1) AS p FROM lab)
    SELECT t AS total, t - p AS normal, p AS insider, {r('100.0 * p / t')} AS insider_pct, {r('(t - p) / p::DOUBLE')} AS normals_per_insider FROM c""",
)
def balance(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.class_balance(stages.labelled_log(spark, sf_dir)))


@query(
    "a17_lost_positives",
    f"""WITH {_seq_sql(10, _LAST)}, u AS (SELECT "user", max(is_anomaly) AS y FROM daily GROUP BY 1),
    q AS (SELECT "user", end_day, max(y) AS y FROM seq GROUP BY 1, 2)
    SELECT 'static' AS stage, count(*) FILTER (y > 0) AS positives FROM u UNION ALL SELECT 'sequences', count(*) FILTER (y > 0) FROM q""",
)
def lost(spark: Spark, sf_dir: str) -> DataFrame:
    """Positive users against positive sequences at stride 10."""
    daily = stages.daily(spark, sf_dir)
    found = windows.sequences(daily, list(_SEQ_FEATURES), stride=10)
    return evaluation.lost_positives(profiles.user_labels(daily), found, "is_anomaly")


@query(
    "a18_score_distribution",
    f"""WITH {PRED} SELECT model, count(*) AS n, {r('min(anomaly_score)')} AS min_score, {r('max(anomaly_score)')} AS max_score,
    {r('avg(anomaly_score)')} AS mean_score, {r('stddev_pop(anomaly_score)')} AS std_score, {r('quantile_cont(anomaly_score, 0.5)')} AS median,
    {r('quantile_cont(anomaly_score, 0.9)')} AS p90, {r('quantile_cont(anomaly_score, 0.95)')} AS p95, {r('quantile_cont(anomaly_score, 0.99)')} AS p99,
    {r('quantile_cont(anomaly_score, 0.999)')} AS p999 FROM pred GROUP BY 1""",
)
def distribution(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.score_distribution(stages.predictions(spark, sf_dir)))


@query(
    "a19_mean_score_by_label",
    f"WITH {PRED} SELECT model, CAST(true_label AS INTEGER) AS label, {r('avg(anomaly_score)')} AS mean_score, count(*) AS n FROM pred GROUP BY 1, 2",
)
def mean_by_label(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.mean_score_by_label(stages.predictions(spark, sf_dir)))


@query(
    "a21_score_histogram",
    f"""WITH {PRED}, b AS (SELECT model, true_label, min(anomaly_score) AS l0, max(anomaly_score) AS h0 FROM pred GROUP BY 1, 2),
    w AS (SELECT model, true_label, CASE WHEN l0 = h0 THEN l0 - 0.5 ELSE l0 END AS lo, CASE WHEN l0 = h0 THEN h0 + 0.5 ELSE h0 END AS hi FROM b)
    SELECT pred.model, CAST(pred.true_label AS INTEGER) AS label, CAST(least(floor((anomaly_score - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n,
    {r('max(lo)')} AS range_low, {r('max(hi)')} AS range_high FROM pred JOIN w ON w.model = pred.model AND w.true_label = pred.true_label GROUP BY 1, 2, 3""",
)
def histogram(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(evaluation.score_histogram(stages.predictions(spark, sf_dir)))


# --- forensics --------------------------------------------------------------

_ABS = " UNION ALL ".join(
    f"SELECT '{z}' AS feature, {i} AS o, avg(abs({z})) AS v, max({z}) AS mx FROM pz WHERE is_insider_max > 0" for i, z in enumerate(_Z)
)


@query(
    "a22_feature_deviation",
    f"WITH {_PEER_SQL} SELECT feature, {r('v', 3)} AS mean_abs FROM ({_ABS})",
)
def feature_deviation(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(forensics.feature_deviation(enriched_daily(spark, sf_dir), _Z, "is_insider_max"), 3)


@query(
    "a22_most_telling_feature",
    f"WITH {_PEER_SQL} SELECT feature, {r('v', 3)} AS mean_abs FROM ({_ABS}) ORDER BY v DESC, o LIMIT 1",
)
def telling_feature(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(forensics.most_telling_feature(enriched_daily(spark, sf_dir), _Z, "is_insider_max"), 3)


@query(
    "a22_largest_column",
    f"WITH {_PEER_SQL} SELECT feature, {r('mx', 3)} AS max_value FROM ({_ABS}) ORDER BY mx DESC, o LIMIT 1",
)
def largest_column(spark: Spark, sf_dir: str) -> DataFrame:
    positive = enriched_daily(spark, sf_dir).where(F.col("is_insider_max") > 0)
    return rounded(forensics.largest_column(positive, _Z), 3)


_IMP = tuple(profiles.DAILY_MEASURES)


@query(
    "e11_feature_importance",
    f"""WITH {PRED}, st AS (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in _IMP)} FROM daily),
    z AS (SELECT "user", day, {', '.join(f'({f} - m_{f}) / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END AS {f}' for f in _IMP)} FROM daily, st),
    a AS (SELECT model, {', '.join(f'avg(abs({f})) AS {f}' for f in _IMP)} FROM pred JOIN z USING ("user", day) WHERE prediction > 0 GROUP BY 1)
    """
    + " UNION ALL ".join(f"SELECT model, '{f}' AS feature, {r(f'{f} / ({chr(43).join(_IMP)})')} AS importance FROM a" for f in _IMP),
)
def importance(spark: Spark, sf_dir: str) -> DataFrame:
    """Share of each scaled measure in the rows a model flags."""
    from dayglass.operators.scaling import scale

    daily = stages.daily(spark, sf_dir).select("user", "day", *_IMP)
    scaled = scale(daily, list(_IMP))
    flagged = stages.predictions(spark, sf_dir).where(F.col("prediction") > 0).select("model", "user", "day", "prediction")
    return rounded(forensics.feature_importance(flagged.join(scaled, ["user", "day"]), list(_IMP)))


@query(
    "j12_drill_down",
    f"""WITH {PRED}, top AS (SELECT "user" FROM pred WHERE model = 'isolation_forest' ORDER BY true_label DESC, anomaly_score DESC, "user" LIMIT 1)
    SELECT daily."user", daily.day, daily_activity_count, unique_pcs FROM daily JOIN top ON top."user" = daily."user" """,
)
def drill_down(spark: Spark, sf_dir: str) -> DataFrame:
    scores = stages.predictions(spark, sf_dir).where(F.col("model") == "isolation_forest")
    daily = stages.daily(spark, sf_dir).select("user", "day", "daily_activity_count", "unique_pcs")
    return forensics.drill_down(daily, scores)


@query(
    "w7_score_timeline",
    f"""WITH {WIDE} SELECT row_number() OVER (ORDER BY "user", day) - 1 AS index, "user", day, {r('score')} AS anomaly_score,
    CAST(true_label > 0 AS INTEGER) AS is_true_anomaly, CAST(score > {LOW} AS INTEGER) AS above_threshold FROM ens""",
)
def timeline(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(forensics.score_timeline(ensemble.combine(stages.predictions(spark, sf_dir)), LOW))


@query(
    "q17_attack_days",
    f"""WITH {WIDE}, k AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, day) AS k FROM ens)
    SELECT "user", day AS attack_day, {r('score')} AS max_score FROM k WHERE k = 1""",
)
def attack_days(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(forensics.attack_days(ensemble.combine(stages.predictions(spark, sf_dir))))


@query(
    "q17_user_timeline",
    f"""WITH {WIDE}, k AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, day) AS k FROM ens)
    SELECT "user", day, {r('score')} AS anomaly_score, CAST(k = 1 AS INTEGER) AS is_attack_day FROM k""",
)
def user_timeline(spark: Spark, sf_dir: str) -> DataFrame:
    """Timelines of all users with their attack days."""
    return rounded(forensics.user_timeline(ensemble.combine(stages.predictions(spark, sf_dir))))


@query(
    "q17_insider_timeline",
    f"""WITH {WIDE}, k AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, day) AS k FROM ens)
    SELECT "user", day, {r('score')} AS anomaly_score, CAST(k = 1 AS INTEGER) AS is_attack_day FROM k
    WHERE "user" IN (SELECT "user" FROM ens WHERE true_label > 0)""",
)
def insider_timeline(spark: Spark, sf_dir: str) -> DataFrame:
    """Timelines of the labelled users only."""
    scored = ensemble.combine(stages.predictions(spark, sf_dir))
    return rounded(forensics.user_timeline(scored, forensics.scored_positives(scored)))
