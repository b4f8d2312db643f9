"""Daily and per-user profiles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass import config

# Measures of the daily profile, in output order.
DAILY_MEASURES = (
    "daily_activity_count",
    "unique_pcs",
    "unique_ips",
    "first_activity_hour",
    "last_activity_hour",
    "work_duration_hours",
    "logon_count",
    "logoff_count",
    "file_access_count",
    "email_count",
    "usb_connect_count",
    "web_visit_count",
    "after_hours_activity",
)

# Which activity each counter looks for (column, value).
DAILY_COUNTERS = {
    "logon_count": ("activity", "Logon"),
    "logoff_count": ("activity", "Logoff"),
    "file_access_count": ("activity", "File Open"),
    "email_count": ("activity", "Email"),
    "usb_connect_count": ("activity", "Connect"),
    "web_visit_count": ("activity", "http"),
}

# Flags summed by the role-aware daily profile.
ROLE_FLAGS = (
    "is_logon",
    "is_logoff",
    "is_connect",
    "is_disconnect",
    "has_attachment",
    "is_large_email",
    "is_suspicious_domain",
    "is_sensitive_file",
)


def _distinct_with_null(column: str) -> Column:
    """Number of distinct values, null counting as one."""
    return F.count_distinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def daily_profile(
    events: DataFrame,
    user: str = "user_id",
    ts: str = "date",
    label: str = "is_insider",
    count_by: str = "activity",
    ip: str | None = None,
    counters: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per user and day with the 13 daily measures and, if labelled, ``is_anomaly``.

    ``count_by`` is the column whose non-null values count as activity. Rows
    without a date are dropped; null measures become 0.
    """
    hour = F.hour(ts)
    counters = counters or DAILY_COUNTERS
    measures = {
        "daily_activity_count": F.count(count_by),
        "unique_pcs": _distinct_with_null("pc_id"),
        "unique_ips": _distinct_with_null(ip) if ip else F.max(F.lit(0)).cast("long"),
        "first_activity_hour": F.min(hour),
        "last_activity_hour": F.max(hour),
        "work_duration_hours": F.max(hour) - F.min(hour),
        **{n: F.count_if(F.col(c) == v) for n, (c, v) in counters.items()},
        "after_hours_activity": F.count_if((hour < 7) | (hour > 19)),
    }
    if label in events.columns:
        measures["is_anomaly"] = F.max(label)
    grouped = (
        events.where(F.col(ts).isNotNull())
        .groupBy(F.col(user).alias("user"), F.to_date(ts).alias("day"))
        .agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in measures.items()])
    )
    return grouped


def measure_columns(daily: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Columns of a daily profile that are measures, not keys or labels."""
    keys = {"user", "user_id", "day", "date", "dataset", "role", "is_anomaly", "is_insider"}
    keys |= {"is_insider_max"} | set(exclude)
    return [c for c in daily.columns if c not in keys]


def role_daily_profile(events: DataFrame, ts: str = "date") -> DataFrame:
    """Daily sums per user, dataset and role; null measures count as 0, null keys are dropped."""

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)) if c in events.columns else F.lit(0)

    size = filled("email_size_kb").cast("double")
    keyed = events.where(
        F.col(ts).isNotNull()
        & F.col("user_id").isNotNull()
        & F.col("dataset").isNotNull()
        & F.col("role").isNotNull()
    )
    return keyed.groupBy(F.to_date(ts).alias("date"), "user_id", "dataset", "role").agg(
        *[F.sum(filled(c)).cast("long").alias(f"{c}_sum") for c in ROLE_FLAGS[:4]],
        F.sum(size).alias("email_size_kb_sum"),
        F.avg(size).alias("email_size_kb_mean"),
        *[F.sum(filled(c)).cast("long").alias(f"{c}_sum") for c in ROLE_FLAGS[4:]],
        F.count("activity_type").alias("activity_type_count"),
        F.max(F.col("is_insider")).cast("long").alias("is_insider_max"),
    )


def type_counts(kinds: Iterable[str], column: str = "activity_type") -> list[Column]:
    """One ``count_<kind>`` aggregate per kind, to fold into any grouping."""
    return [F.count_if(F.col(column) == k).alias(f"count_{k}") for k in kinds]


def pivot_type_counts(
    events: DataFrame, keys: list[str | Column], kinds: Iterable[str] = config.LOG_KINDS
) -> DataFrame:
    """Activity counts by kind, zero where a kind is absent."""
    return events.groupBy(*keys).agg(*type_counts(kinds))


def windowed_profile(
    events: DataFrame,
    window: str = "1 day",
    user: str = "user_id",
    ts: str = "date",
    kinds: Iterable[str] = config.LOG_KINDS,
) -> DataFrame:
    """Profile per user and time window of any length; optional columns are used when present.

    Expects the calendar columns of ``add_calendar``.
    """
    columns = events.columns
    aggregates = [F.count("activity_type").alias("activity_count")]
    optional = {
        "is_weekend": [F.max("is_weekend").alias("is_weekend")],
        "is_business_hours": [F.count_if(F.col("is_business_hours") == 0).alias("after_hours_count")],
        "is_connect": [F.sum("is_connect").alias("device_connects")],
        "has_attachment": [F.sum("has_attachment").alias("emails_with_attachments")],
        "email_size_kb": [
            F.sum("email_size_kb").alias("total_email_size_kb"),
            F.avg("email_size_kb").alias("avg_email_size_kb"),
        ],
        "is_suspicious_domain": [F.sum("is_suspicious_domain").alias("suspicious_http_count")],
        **{c: [F.avg(c).alias(c)] for c in config.TRAITS},
    }
    for name, parts in optional.items():
        if name in columns:
            aggregates += parts
    if "is_insider" in columns:
        aggregates.append(F.max("is_insider").alias("is_insider"))
    start = F.window(F.col(ts), window).start.alias("date")
    kept = events.where(F.col(ts).isNotNull() & F.col(user).isNotNull())
    return kept.groupBy(F.col(user).alias("user"), start).agg(*aggregates, *type_counts(kinds)).na.fill(0)


def weekend_profile(
    events: DataFrame, user: str = "user_id", ts: str = "date", kinds: Iterable[str] = config.LOG_KINDS
) -> DataFrame:
    """Daily counts with weekend and after-hours activity and their shares."""
    from dayglass.functions.numeric import guarded_ratio

    counted = (
        events.where(F.col(ts).isNotNull() & F.col(user).isNotNull())
        .groupBy(F.col(user).alias("user"), F.to_date(ts).alias("date"))
        .agg(
            F.count("activity_type").alias("activity_count"),
            *type_counts(kinds),
            F.sum("is_weekend").cast("long").alias("weekend_activity_count"),
            F.count_if(F.col("is_business_hours") == 0).alias("after_hours_count"),
            *(
                [F.sum("is_connect").cast("long").alias("device_connects")]
                if "is_connect" in events.columns
                else []
            ),
        )
    )
    whole = F.col("activity_count")
    return counted.withColumns(
        {
            "after_hours_ratio": guarded_ratio(F.col("after_hours_count"), whole),
            "weekend_activity_ratio": guarded_ratio(F.col("weekend_activity_count"), whole),
        }
    )


def static_profile(daily: DataFrame, user: str = "user", measures: list[str] | None = None) -> DataFrame:
    """Mean and sample standard deviation of every measure per user, null read as 0."""
    measures = measures or measure_columns(daily)
    parts = []
    for m in measures:
        parts.append(F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_mean"))
        parts.append(F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))
    return daily.groupBy(user).agg(*parts)


def statistics_profile(
    daily: DataFrame,
    user: str = "user",
    measures: list[str] | None = None,
    with_sum: bool = False,
    fill: bool = False,
) -> DataFrame:
    """Mean, sample std, min, max, median (and sum) per user.

    The built-in exact median is safe here: a user has at most one row a day.
    """
    functions = {
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "median": F.median,
    }
    if with_sum:
        functions["sum"] = F.sum
    parts = [
        f(m).alias(f"{m}_{n}")
        for m in (measures or measure_columns(daily))
        for n, f in functions.items()
    ]
    stats = daily.groupBy(user).agg(*parts)
    return stats.na.fill(0) if fill else stats


def full_static_table(
    daily: DataFrame,
    attributes: DataFrame,
    categories: dict[str, list[str]],
    user: str = "user",
    label: str = "is_anomaly",
    measures: list[str] | None = None,
) -> DataFrame:
    """Per user: statistics of every measure, its attributes, and ``is_insider``, nulls read as 0.

    ``attributes`` has one row per user; its columns in ``categories`` become 0/1 columns,
    null being a category of its own, and the others stay as they are. A user without
    attributes has 0 in all of them.
    """
    from dayglass.operators.cleaning import one_hot

    stats = statistics_profile(daily, user, measures, with_sum=True, fill=True)
    encoded = attributes
    for column, names in categories.items():
        encoded = one_hot(encoded, column, names)
    labels = daily.groupBy(user).agg(F.max(label).alias("is_insider"))
    return stats.join(encoded, user, "left").na.fill(0).join(labels, user).na.fill(0, ["is_insider"])


def zscore_profile(enriched: DataFrame, user: str = "user_id", label: str = "is_insider_max") -> DataFrame:
    """Per user: max and mean of z-score columns, sums of base columns, label maximum."""
    parts = []
    for c in enriched.columns:
        if "zscore" in c:
            parts.append(F.max(c).alias(f"{c}_max"))
            parts.append(F.avg(c).alias(f"{c}_mean"))
    for c in enriched.columns:
        if c.endswith(("_sum", "_mean", "_count")):
            parts.append(F.sum(c).alias(f"{c}_sum"))
    grouped = enriched.groupBy(user).agg(*parts, F.max(label).alias("is_insider"))
    return grouped.na.fill(0)


def user_scores(predictions: DataFrame, user: str = "user") -> DataFrame:
    """A user's score per model is the maximum over its rows; so is the label."""
    return predictions.groupBy("model", user).agg(
        F.max("anomaly_score").alias("score"), F.max("true_label").alias("label")
    )


def user_labels(daily: DataFrame, user: str = "user", label: str = "is_anomaly") -> DataFrame:
    return daily.groupBy(user).agg(F.max(label).alias(label))
