"""Event labels from incident windows, user lists and activity volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass.functions.numeric import mean_abs
from dayglass.functions.text import pseudonym
from dayglass.operators.ordering import quantiles, row_numbers


def merge_windows(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint closed windows per key: overlapping or touching ones become one."""
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("start", "end")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = Window.partitionBy(*keys).orderBy("start", "end")
    valid = windows.where(F.col("start") <= F.col("end")).select(*keys, "start", "end")
    marked = valid.withColumn(
        "_new",
        F.coalesce(F.col("start") > F.max("end").over(earlier), F.lit(True)).cast("int"),
    )
    islands = marked.withColumn("_island", F.sum("_new").over(running))
    return (
        islands.groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_island")
    )


def _month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def label_by_windows(
    events: DataFrame,
    windows: DataFrame,
    keys: tuple[str, ...] = ("user_id", "dataset"),
    ts: str = "date",
    out: str = "is_insider",
) -> DataFrame:
    """1 for events of a listed key inside any of its closed windows, else 0.

    Windows are merged and cut by calendar month, so the list met by an event
    stays short however many windows a key has, and no event is duplicated.
    An ``out`` column that already exists is only ever raised to 1.
    """
    group = list(keys)
    merged = merge_windows(windows, group)
    months = F.explode(F.sequence(_month_number(F.col("start")), _month_number(F.col("end"))))
    monthly = (
        merged.select(*group, "start", "end", months.alias("_month"))
        .groupBy(*group, "_month")
        .agg(F.collect_list(F.struct("start", "end")).alias("_windows"))
    )
    dated = events.withColumn("_month", _month_number(F.col(ts)))
    joined = dated.join(monthly, group + ["_month"], "left")
    inside = F.exists("_windows", lambda w: F.col(ts).between(w["start"], w["end"]))
    flag = F.coalesce(inside, F.lit(False)).cast("int")
    if out in events.columns:
        flag = F.greatest(F.coalesce(F.col(out).cast("int"), F.lit(0)), flag)
    return joined.select(*[F.col(c) for c in events.columns if c != out], flag.alias(out))


def label_pseudonyms(
    events: DataFrame, windows: DataFrame, user: str = "user_pseudo", ts: str = "date"
) -> DataFrame:
    """Window labelling where events carry pseudonyms and windows carry real ids."""
    hidden = windows.select(pseudonym(F.col("user_id")).alias(user), "start", "end")
    return label_by_windows(events, hidden, (user,), ts)


def label_by_members(
    events: DataFrame, members: DataFrame, keys: tuple[str, ...] = ("user_id",), out: str = "is_insider"
) -> DataFrame:
    """1 for every event of a listed key, else 0."""
    group = list(keys)
    listed = members.select(*group).distinct().withColumn("_listed", F.lit(1))
    joined = events.join(listed, group, "left")
    kept = [F.col(c) for c in events.columns if c != out]
    return joined.select(*kept, F.coalesce(F.col("_listed"), F.lit(0)).alias(out))


def label_events(
    events: DataFrame,
    windows: DataFrame | None = None,
    members: DataFrame | None = None,
    keys: tuple[str, ...] = ("user_id", "dataset"),
) -> DataFrame:
    """Windows if there are any, else the user list, else all 0."""
    if windows is not None:
        return label_by_windows(events, windows, keys)
    if members is not None:
        return label_by_members(events, members)
    return events.withColumn("is_insider", F.lit(0))


def most_active_users(events: DataFrame, share: float = 0.01, user: str = "user_id") -> DataFrame:
    """The top share of users by event count, at least one, smaller id first on ties."""
    counts = events.groupBy(user).agg(F.count(F.lit(1)).alias("events"))
    wanted = counts.agg(
        F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(share))).cast("long")
    ).scalar()
    ranked = row_numbers(counts, [-F.col("events"), F.col(user)], out="rank")
    return ranked.where(F.col("rank") <= wanted).select(user, "events")


def label_most_active(events: DataFrame, share: float = 0.01, user: str = "user_id") -> DataFrame:
    return label_by_members(events, most_active_users(events, share, user), (user,))


def label_outliers(
    df: DataFrame, features: list[str], quantile: float = 0.998, out: str = "is_insider"
) -> DataFrame:
    """Stand-in labels when none exist: mean absolute value above its quantile."""
    scored = df.withColumn("mean_zscore", mean_abs([F.col(c) for c in features]))
    limit = quantiles(scored.select("mean_zscore"), "mean_zscore", {"q": quantile}).scalar()
    return scored.withColumn(out, (F.col("mean_zscore") > limit).cast("int"))
