"""Detectors on inputs whose scores follow from counts and means alone, so that SQL gives them too.

A forest whose trees see a whole table with one 0/1 measure cuts between the sides first:
a row's path is 1 plus the mean path among the rows of its side. Two clusters that lie far
apart have their means as centres, and with all components nothing is lost. Two days of
one measure have the diagonal as their first component. All components together keep the
length of a row. A run with the real detectors has the keys, labels, models and arithmetic
of its inputs, whatever the scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass import config
from dayglass.detectors import isolation_forest, latent, sequence
from dayglass.operators import alerts, ensemble, splits, windows
from dayglass.plans import batch, stages
from dayglass.plans.catalog_profiles import _LAST, _seq_sql
from dayglass.plans.oracle_parts import DAILY, r
from dayglass.plans.registry import query
from dayglass.session import scratch_path
from dayglass.sources import adapter

Spark = SparkSession

# --- forests ----------------------------------------------------------------

# one row for each nation and segment, however many customers there are
_SIDES = """sides AS (
   SELECT c_nationkey || '-' || c_mktsegment AS "user", DATE '2024-01-01' AS day,
     CAST(avg(c_acctbal) > 4500 AS INTEGER) AS side, CAST(count(*) % 4 = 0 AS INTEGER) AS y
   FROM customer GROUP BY c_nationkey, c_mktsegment)"""


def _mean_path(n: str) -> str:
    return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2.0 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END"


def _forest_sql(train: str) -> str:
    """``f``: the raw score of each side in a forest whose trees all see ``train``."""
    return f"""c AS (SELECT count(*) AS n, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM {train}),
   paths AS (SELECT n, n0, n1, {_mean_path('n')} AS whole, 1 + {_mean_path('n0')} AS p0, 1 + {_mean_path('n1')} AS p1 FROM c),
   f AS (SELECT 0 AS side, CASE WHEN n0 = 0 OR n1 = 0 THEN 0.5 ELSE power(2.0, -p0 / whole) END AS s FROM paths
     UNION ALL SELECT 1, CASE WHEN n0 = 0 OR n1 = 0 THEN 0.5 ELSE power(2.0, -p1 / whole) END FROM paths)"""


def _sides(spark: Spark, sf_dir: str) -> DataFrame:
    people = adapter.table(spark, sf_dir, "customer")
    return people.groupBy("c_nationkey", "c_mktsegment").agg(
        F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("user"),
        F.to_date(F.lit("2024-01-01")).alias("day"),
        (F.avg("c_acctbal") > 4500).cast("int").alias("side"),
        (F.count(F.lit(1)) % 4 == 0).cast("int").alias("y"),
    ).select("user", "day", "side", "y")


_WHOLE = config.ForestParams(trees=8, sample_size=1_024)  # more than there are nations and segments


@query(
    "m4_forest_two_sides",
    f"""WITH {_SIDES}, {_forest_sql('sides')}
    SELECT "user", day, y AS true_label, CAST(s > 0.5 AS INTEGER) AS prediction, {r('s - 0.5')} AS anomaly_score FROM sides JOIN f USING (side)""",
)
def forest_two_sides(spark: Spark, sf_dir: str) -> DataFrame:
    """Path lengths of a forest that sees all rows."""
    scored = isolation_forest.isolation_forest(_sides(spark, sf_dir), ["side"], label="y", params=_WHOLE)
    return scored.select("user", "day", "true_label", "prediction", F.round("anomaly_score", 6).alias("anomaly_score"))


@query(
    "m5_forest_two_sides_on_normals",
    f"""WITH {_SIDES}, train AS (SELECT * FROM sides WHERE y = 0), {_forest_sql('train')},
    t AS (SELECT quantile_cont(s, 0.95) AS q FROM train JOIN f USING (side)),
    b AS (SELECT min(s) AS lo, max(s) AS hi FROM sides JOIN f USING (side))
    SELECT "user", day, y AS true_label, CAST(s > q + 1e-9 AS INTEGER) AS prediction,
      {r('CASE WHEN hi - lo < 1e-10 THEN 0 ELSE (s - lo) / (hi - lo) END')} AS anomaly_score
    FROM sides JOIN f USING (side), t, b""",
)
def forest_two_sides_on_normals(spark: Spark, sf_dir: str) -> DataFrame:
    """The same fitted on normal rows, with the threshold of their scores."""
    rows = _sides(spark, sf_dir)
    normal = rows.where(F.col("y") == 0)
    scored = isolation_forest.isolation_forest_on_normals(normal, normal, rows, ["side"], label="y", params=_WHOLE)
    return scored.select("user", "day", "true_label", "prediction", F.round("anomaly_score", 6).alias("anomaly_score"))


# --- latent clustering ------------------------------------------------------

_TWO = """two AS (SELECT CAST(c_custkey AS VARCHAR) AS "user", 0 AS day, CAST(c_custkey % 11 = 0 AS INTEGER) AS y, c_custkey % 2 AS g,
   CAST(c_acctbal AS DOUBLE) + 1e6 * (c_custkey % 2) AS a, CAST(c_nationkey AS DOUBLE) - 1e4 * (c_custkey % 2) + c_custkey / 1e6 AS b FROM customer)"""


def _two_clusters(spark: Spark, sf_dir: str) -> DataFrame:
    side = F.col("c_custkey") % 2
    return adapter.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("user"),
        F.lit(0).alias("day"),
        (F.col("c_custkey") % 11 == 0).cast("int").alias("y"),
        (F.col("c_acctbal").cast("double") + F.lit(1e6) * side).alias("a"),
        (F.col("c_nationkey").cast("double") - F.lit(1e4) * side + F.col("c_custkey") / F.lit(1e6)).alias("b"),
    )


_CLUSTERS = config.LatentParams(clusters=2, restarts=3, components=2)


@query(
    "m6_latent_two_clusters",
    f"""WITH {_TWO}, st AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM two),
    z AS (SELECT "user", day, y, g, (a - ma) / sa AS a, (b - mb) / sb AS b FROM two, st),
    m AS (SELECT g, avg(a) AS ma, avg(b) AS mb FROM z GROUP BY 1),
    d AS (SELECT "user", day, y, sqrt((a - ma) ** 2 + (b - mb) ** 2) AS d FROM z JOIN m USING (g)),
    s AS (SELECT *, 0.5 * (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) AS s FROM d)
    SELECT "user", day, y AS true_label, CAST(s > (SELECT quantile_cont(s, 0.95) FROM s) AS INTEGER) AS prediction, {r('s', 5)} AS anomaly_score FROM s""",
)
def two_clusters(spark: Spark, sf_dir: str) -> DataFrame:
    """Distances from the means of two clusters far apart; all components lose nothing."""
    scored = latent.latent_clustering(_two_clusters(spark, sf_dir), ["a", "b"], label="y", params=_CLUSTERS)
    return scored.select("user", "day", "true_label", "prediction", F.round("anomaly_score", 5).alias("anomaly_score"))


@query(
    "m7_latent_two_clusters_on_normals",
    f"""WITH {_TWO}, st AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM two WHERE y = 0),
    z AS (SELECT "user", day, y, g, (a - la) / (ha - la) AS a, (b - lb) / (hb - lb) AS b FROM two, st),
    m AS (SELECT g, avg(a) AS ma, avg(b) AS mb FROM z WHERE y = 0 GROUP BY 1),
    d AS (SELECT "user", day, y, sqrt((a - ma) ** 2 + (b - mb) ** 2) AS d FROM z JOIN m USING (g)),
    b AS (SELECT min(d) AS lo, max(d) AS hi, (SELECT quantile_cont(d, 0.95) FROM d WHERE y = 0) AS q FROM d)
    SELECT "user", day, y AS true_label, CAST(d > q AS INTEGER) AS prediction, {r('(d - lo) / (hi - lo)', 5)} AS anomaly_score FROM d, b""",
)
def two_clusters_on_normals(spark: Spark, sf_dir: str) -> DataFrame:
    """Distances from the normal rows' cluster means, threshold from normal rows."""
    rows = _two_clusters(spark, sf_dir)
    normal = rows.where(F.col("y") == 0)
    scored = latent.latent_clustering_on_normals(normal, normal, rows, ["a", "b"], label="y", params=_CLUSTERS)
    return scored.select("user", "day", "true_label", "prediction", F.round("anomaly_score", 5).alias("anomaly_score"))


@query(
    "e10_projection_norms",
    f"""WITH t AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS a, CAST(c_nationkey AS DOUBLE) AS b, CAST(c_custkey % 97 AS DOUBLE) AS c FROM customer),
    st AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM t)
    SELECT c_custkey, CAST(c_custkey % 11 = 0 AS INTEGER) AS is_insider,
      {r('((a - ma) / sa) ** 2 + ((b - mb) / sb) ** 2 + ((c - mc) / sc) ** 2')} AS squared_norm FROM t, st""",
)
def projection_norms(spark: Spark, sf_dir: str) -> DataFrame:
    """Three components of three measures keep every row's length."""
    rows = adapter.table(spark, sf_dir, "customer").select(
        "c_custkey",
        (F.col("c_custkey") % 11 == 0).cast("int").alias("is_insider"),
        F.col("c_acctbal").cast("double").alias("a"),
        F.col("c_nationkey").cast("double").alias("b"),
        (F.col("c_custkey") % 97).cast("double").alias("c"),
    )
    found = latent.projection_3d(rows, ["a", "b", "c"], F.col("c_custkey"))
    norm = F.col("PCA1") ** 2 + F.col("PCA2") ** 2 + F.col("PCA3") ** 2
    return found.select("c_custkey", "is_insider", F.round(norm, 6).alias("squared_norm"))


# --- sequences --------------------------------------------------------------

_PART = """(('0x' || substr(md5('42' || "user" || '|' || CAST(end_day AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"""
_TEST_FROM = config.TRAIN_RATIO + config.VAL_RATIO


def _two_days(spark: Spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = windows.sequences(stages.daily(spark, sf_dir), ["daily_activity_count"], length=2)
    split = splits.assign_split(found, F.concat_ws("|", "user", F.col("end_day").cast("string")))
    return split.where(F.col("split") == "train"), split.where(F.col("split") == "test")


@query(
    "m10_two_day_windows",
    f"""WITH {DAILY}, w AS (SELECT "user", day AS end_day, is_anomaly AS y, CAST(daily_activity_count AS DOUBLE) AS x2,
      lag(CAST(daily_activity_count AS DOUBLE)) OVER (PARTITION BY "user" ORDER BY day) AS x1 FROM daily),
    p AS (SELECT *, {_PART} AS u FROM w WHERE x1 IS NOT NULL),
    st AS (SELECT avg(x1) AS m1, stddev_pop(x1) + 1e-10 AS s1, avg(x2) AS m2, stddev_pop(x2) + 1e-10 AS s2,
      sign(corr(x1, x2)) AS c FROM p WHERE y = 0 AND u < {config.TRAIN_RATIO})
    SELECT "user", end_day AS day, CAST(y AS INTEGER) AS true_label, {r('abs((x1 - m1) / s1 - c * (x2 - m2) / s2) / 2', 5)} AS anomaly_score
    FROM p, st WHERE u >= {_TEST_FROM!r}""",
)
def two_day_windows(spark: Spark, sf_dir: str) -> DataFrame:
    """Two days of one measure, one component: what is lost is the distance from the diagonal."""
    train, test = _two_days(spark, sf_dir)
    scored = sequence.sequence_reconstruction(train, test, components=1)
    return scored.select("user", "day", "true_label", F.round("anomaly_score", 5).alias("anomaly_score"))


# --- a run with the real detectors ------------------------------------------


@query(
    "run_detectors_to_alerts",
    f"""WITH {_seq_sql(1, _LAST)}, q AS (SELECT DISTINCT "user", end_day FROM seq),
    tested AS (SELECT "user", end_day AS day FROM q WHERE {_PART} >= {_TEST_FROM!r})
    SELECT d."user", d.day, CAST(d.is_anomaly AS INTEGER) AS true_label, CAST(2 + (t.day IS NOT NULL)::INTEGER AS INTEGER) AS n_models,
      TRUE AS weighted_holds, TRUE AS majority_holds, TRUE AS cascade_holds, TRUE AS alert_holds
    FROM daily d LEFT JOIN tested t ON d."user" = t."user" AND d.day = t.day""",
)
def detectors_to_alerts(spark: Spark, sf_dir: str) -> DataFrame:
    """Profiles through all three detectors, all ensembles and alerts: keys, labels, models, and whether the arithmetic holds."""
    daily = stages.daily(spark, sf_dir)
    out = scratch_path(spark, "detector-run")
    predictions = batch.run_detectors(daily, windows.sequences(daily, batch.measure_columns(daily)), f"{out}/predictions")
    scored = batch.run_ensembles(predictions, f"{out}/ensemble")
    params = config.EnsembleParams()
    keys = ["user", "day"]
    s, w, p = F.col("anomaly_score"), F.lit(0.0), F.col("prediction")
    for model, weight in params.weights.items():
        w = F.when(F.col("model") == model, F.lit(weight)).otherwise(w)
    by_hand = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("n_models"),
        (F.sum(w * s) / F.sum(w)).alias("_weighted"),
        F.avg(p).alias("_share"),
        F.avg(s).alias("_mean"),
        F.max(s).alias("_widest"),
        F.min(p).alias("_all"),
    )
    raised = alerts.make_alerts(scored["weighted"], params.threshold).select(*keys, F.col("severity").alias("_severity"))
    joined = by_hand
    for method in ("weighted", "majority", "cascade"):
        own = scored[method].select(
            *keys, F.col("true_label").alias(f"_label_{method}"), p.alias(f"_flag_{method}"), s.alias(f"_score_{method}")
        )
        joined = joined.join(own, keys)
    joined = joined.join(raised, keys, "left")

    def near(a: str, b: str):
        return F.abs(F.col(a) - F.col(b)) < 1e-9

    def flagged(method: str):
        return F.col(f"_flag_{method}") == 1

    above = F.col("_score_weighted") > params.threshold
    return joined.select(
        *keys,
        F.col("_label_weighted").cast("int").alias("true_label"),
        "n_models",
        (near("_score_weighted", "_weighted") & (flagged("weighted") == above)).alias("weighted_holds"),
        (near("_score_majority", "_mean") & (flagged("majority") == (F.col("_share") > 0.5))).alias("majority_holds"),
        (near("_score_cascade", "_widest") & (flagged("cascade") == (F.col("_all") == 1))).alias("cascade_holds"),
        (F.col("_severity").isNotNull() == above).alias("alert_holds"),
    )
