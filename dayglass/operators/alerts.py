"""Alerts from combined scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass import config
from dayglass.operators.ordering import cumulative_counts


def severity(score: Column) -> Column:
    """First inclusive band that holds the score; outside all bands it is ``low``."""
    out = None
    for name, low, high in config.SEVERITY_BANDS:
        inside = (score >= low) & (score <= high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("low")


def severity_rank(level: Column) -> Column:
    out = None
    for name, rank in config.SEVERITY_RANK.items():
        out = F.when(level == name, rank) if out is None else out.when(level == name, rank)
    return out


def alert_id(index: Column) -> Column:
    """``ALERT_`` and the index padded to six digits; longer ones stay whole."""
    digits = index.cast("string")
    padded = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    return F.concat(F.lit("ALERT_"), padded)


def make_alerts(
    ensemble: DataFrame,
    threshold: float = config.EnsembleParams().threshold,
    keys: tuple[str, ...] = ("user", "day"),
    numbered: bool = True,
) -> DataFrame:
    """Alerts for scores strictly above the threshold; an empty typed table when there are none.

    ``index`` is the row's position in key order among all scored rows: the rows of
    earlier users, from running counts over users, and the user's own earlier rows,
    which are ordered for users with an alert only. Counts and shares of alerts need
    no position; ``numbered=False`` leaves it out, and the id made from it.
    """
    flagged = F.col("anomaly_score") > threshold
    found, position = ensemble, []
    if numbered:
        user, rest = keys[0], keys[1:] or keys
        rows = cumulative_counts(ensemble, user, {"_rows": F.count(F.lit(1)), "_alerts": F.count_if(flagged)})
        starts = rows.where(F.col("_alerts") > 0).select(
            F.col(user).alias("_user"), (F.col("cum__rows") - F.col("_rows")).alias("_before")
        )
        own = F.row_number().over(Window.partitionBy(user).orderBy(*rest)) - 1
        theirs = ensemble.join(starts, F.col(user).eqNullSafe(F.col("_user")))
        found = theirs.withColumn("_index", (own + F.col("_before")).cast("long"))
        position = [alert_id(F.col("_index")).alias("alert_id"), F.col("_index").alias("index")]
    return found.where(flagged).select(
        *position,
        *keys,
        "anomaly_score",
        severity(F.col("anomaly_score")).alias("severity"),
        F.concat_ws(", ", "contributing_models").alias("contributing_models"),
        "num_models_agree",
    )


def order_alerts(alerts: DataFrame) -> DataFrame:
    """Most severe first, then highest score, then position."""
    return alerts.orderBy(severity_rank(F.col("severity")).desc(), F.desc("anomaly_score"), F.asc("index"))


def top_alerts(alerts: DataFrame, k: int = 10) -> DataFrame:
    return order_alerts(alerts).limit(k)


def severity_counts(alerts: DataFrame) -> DataFrame:
    """Count and percentage of alerts per severity (at most four rows)."""
    counts = alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))
    whole = alerts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share_pct", 100.0 * F.col("alerts") / whole)


def agreement_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("num_models_agree").agg(F.count(F.lit(1)).alias("alerts"))
