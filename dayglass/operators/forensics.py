"""Looking closer: telling features, one user's story, score timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.operators.ordering import row_numbers, with_group_stats


def feature_deviation(df: DataFrame, features: list[str], label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``feature, mean_abs`` over positive rows: one aggregate, then one row per feature."""
    positive = df.where(F.col(label) > 0)
    grouped = positive.groupBy(*by) if by else positive
    stats = grouped.agg(*[F.avg(F.abs(F.col(f))).alias(f"a{i}") for i, f in enumerate(features)])
    cells = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"a{i}").alias("mean_abs")) for i, f in enumerate(features)]
    )
    return stats.select(*by, F.inline(cells))


def most_telling_feature(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Feature with the highest mean absolute value among positives, first listed on ties."""
    return _arg_max(feature_deviation(df, features, label), features, "mean_abs")


def _arg_max(table: DataFrame, features: list[str], value: str) -> DataFrame:
    position = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    present = table.where(F.col(value).isNotNull())
    return present.orderBy(F.desc(value), position).limit(1).select("feature", value)


def largest_column(df: DataFrame, features: list[str]) -> DataFrame:
    """Column holding the largest value, first listed on ties: ``feature, max_value``."""
    stats = df.agg(*[F.max(f).alias(f"a{i}") for i, f in enumerate(features)])
    cells = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"a{i}").alias("max_value")) for i, f in enumerate(features)]
    )
    return _arg_max(stats.select(F.inline(cells)), features, "max_value")


def feature_importance(flagged: DataFrame, features: list[str], label: str = "prediction") -> DataFrame:
    """Share of each feature in a model's mean absolute deviations: ``model, feature, importance``."""
    cells = feature_deviation(flagged, features, label, by=("model",))
    summed = with_group_stats(cells, ["model"], {"_all": F.sum("mean_abs")})
    return summed.select(
        "model", "feature", F.coalesce(F.try_divide(F.col("mean_abs"), F.col("_all")), F.lit(0.0)).alias("importance")
    )


def top_user(scores: DataFrame, user: str = "user", score: str = "anomaly_score", label: str = "true_label") -> DataFrame:
    """Highest-scoring labelled user, or the highest-scoring one when none is labelled."""
    labelled = (F.col(label) > 0).cast("int")
    return scores.orderBy(labelled.desc(), F.desc(score), F.asc(user)).limit(1).select(user)


def drill_down(daily: DataFrame, scores: DataFrame, user: str = "user") -> DataFrame:
    """Daily rows of the top user; the one-row user list prunes the daily table."""
    return daily.join(F.broadcast(top_user(scores, user)), user, "left_semi")


def score_timeline(scored: DataFrame, threshold: float, keys: tuple[str, ...] = ("user", "day")) -> DataFrame:
    """Rows numbered in key order with score, positive marker and threshold flag."""
    numbered = row_numbers(scored, [F.col(k) for k in keys], out="_n")
    return numbered.select(
        (F.col("_n") - 1).alias("index"),
        *keys,
        "anomaly_score",
        (F.col("true_label") > 0).cast("int").alias("is_true_anomaly"),
        (F.col("anomaly_score") > threshold).cast("int").alias("above_threshold"),
    )


def user_timeline(scored: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Daily scores of the given users (default all) with each one's attack day marked.

    The attack day has the user's highest score, the earliest one on ties. A
    user has at most one row a day, so no join partition grows with events.
    """
    own = scored if users is None else scored.join(users.select("user").distinct(), "user", "left_semi")
    peaks = attack_days(own).select("user", "attack_day")
    return own.join(peaks, "user").select(
        "user", "day", "anomaly_score", (F.col("day") == F.col("attack_day")).cast("int").alias("is_attack_day")
    )


def attack_days(scored: DataFrame) -> DataFrame:
    """Every user's day with the highest score, the earliest on ties."""
    order = F.struct(F.col("anomaly_score"), -F.datediff("day", F.lit("1970-01-01")))
    return scored.groupBy("user").agg(
        F.max_by("day", order).alias("attack_day"), F.max("anomaly_score").alias("max_score")
    )


def scored_positives(aligned: DataFrame) -> DataFrame:
    """Positives with every model's score, from an aligned table."""
    return aligned.where(F.col("true_label") > 0)
