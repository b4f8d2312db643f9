"""Per-user windows over daily rows: z-scores and sequences.

Windows are partitioned by user over daily rows, so a partition holds at most
one row per day (and dataset) however many events the user has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass import config
from dayglass.functions.numeric import zscore
from dayglass.operators.moments import moments, sample_std
from dayglass.session import materialise


def self_zscores(
    daily: DataFrame,
    measures: list[str],
    user: str = "user_id",
    order: tuple[str, ...] = ("date", "dataset", "role"),
    days: int = config.SELF_WINDOW_DAYS,
) -> DataFrame:
    """``<measure>_zscore_self``: against the user's own trailing rows, this one included."""
    present = [c for c in order if c in daily.columns]
    frame = Window.partitionBy(user).orderBy(*present).rowsBetween(-(days - 1), 0)
    scores = []
    for m in measures:
        x = F.col(m).cast("double")
        scores.append(
            zscore(x, F.avg(x).over(frame), F.stddev_samp(x).over(frame)).alias(f"{m}_zscore_self")
        )
    return daily.select("*", *scores)


def extend_self_zscores(
    tail: DataFrame,
    new: DataFrame,
    measures: list[str],
    user: str = "user_id",
    order: tuple[str, ...] = ("date", "dataset", "role"),
    days: int = config.SELF_WINDOW_DAYS,
) -> tuple[DataFrame, DataFrame]:
    """Self z-scores of new daily rows from the rows that reach into their windows, and the next such rows.

    ``tail`` holds each user's last ``days`` - 1 rows before the new ones; so does the
    second table for the time after them. Only users with new rows, and no other days, are
    read for the scores.
    """
    present = [c for c in order if c in new.columns]
    both = tail.select(*new.columns, F.lit(False).alias("_new")).unionByName(new.withColumn("_new", F.lit(True)))
    both = materialise(both, "self-tail")
    touched = both.where("_new").select(user).distinct()
    scored = self_zscores(both.join(touched, user, "left_semi"), measures, user, order, days).where("_new").drop("_new")
    last = Window.partitionBy(user).orderBy(*[F.desc(c) for c in present])
    kept = both.drop("_new").withColumn("_age", F.row_number().over(last)).where(F.col("_age") < days).drop("_age")
    return scored.select(*new.columns, *[f"{m}_zscore_self" for m in measures]), materialise(kept, "self-tail")


def peer_zscores(
    daily: DataFrame, measures: list[str], group: tuple[str, ...] = ("role", "date"), stats: DataFrame | None = None
) -> DataFrame:
    """``<measure>_zscore_peer``: against everyone of the same role on the same date.

    ``stats`` are stored moments of the groups (see ``moments``), made from ``daily``
    where none are given. They are joined back: a window over the group would pull a role
    with a third of all users into one task per date. Spark broadcasts the moments when
    their measured size allows.
    """
    keys = list(group)
    stats = moments(daily, keys, measures) if stats is None else stats
    own = stats.select(*keys, *[F.col(m).alias(f"_of_{m}") for m in measures])
    scores = [
        zscore(
            F.col(m).cast("double"), F.when(F.col(f"_of_{m}.n") > 0, F.col(f"_of_{m}.mean")), sample_std(F.col(f"_of_{m}"))
        ).alias(f"{m}_zscore_peer")
        for m in measures
    ]
    return daily.join(own, keys).select(*[F.col(c) for c in daily.columns], *scores)


def user_series(
    daily: DataFrame, features: list[str], user: str = "user", day: str = "day", label: str | None = "is_anomaly"
) -> DataFrame:
    """One row per user: ``user`` and ``points``, its daily rows in order of day (``day, row, label``).

    Stored in place of sequences, which repeat every day once for each window it is in.
    A user has one point a day however many events there are.
    """
    row = F.array(*[F.col(c).cast("double") for c in features])
    mark = F.col(label).cast("int") if label is not None and label in daily.columns else F.lit(None).cast("int")
    point = F.struct(F.col(day).alias("day"), row.alias("row"), mark.alias("label"))
    return daily.groupBy(F.col(user).alias("user")).agg(F.sort_array(F.collect_list(point)).alias("points"))


def sequence_views(
    series: DataFrame, length: int = config.SEQUENCE_LENGTH, stride: int = 1, label_rule: str = "last"
) -> DataFrame:
    """Windows of ``length`` points of each series, cut as they are read: ``user, end_day, seq, label``.

    ``label_rule`` is ``last`` (label of the last day) or ``any``. Users with fewer points
    give none. ``stride`` counts from a user's first point.
    """
    if label_rule not in ("last", "any"):
        raise ValueError(f"unknown label rule {label_rule}")

    def views(points: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(points) - length + 1, F.lit(1)), F.lit(stride))

        def view(start: Column) -> Column:
            inside = F.slice(points, start, length)
            last = F.element_at(points, start + length - 1)
            if label_rule == "last":
                mark = last["label"]
            else:
                mark = F.exists(inside, lambda p: F.coalesce(p["label"] == 1, F.lit(False))).cast("int")
            return F.struct(
                last["day"].alias("end_day"), F.transform(inside, lambda p: p["row"]).alias("seq"),
                F.coalesce(mark, F.lit(0)).alias("label"),
            )

        return F.transform(first, view)

    long_enough = series.where(F.size("points") >= length)
    # the points are bound once, so no view sorts them again
    bound = F.flatten(F.transform(F.array("points"), views))
    return long_enough.select("user", F.inline(bound))


def sequences(
    daily: DataFrame,
    features: list[str],
    length: int = config.SEQUENCE_LENGTH,
    stride: int = 1,
    label_rule: str = "last",
    user: str = "user",
    day: str = "day",
    label: str | None = "is_anomaly",
) -> DataFrame:
    """Sliding windows of ``length`` daily rows per user: ``user, end_day, seq, label`` (see ``sequence_views``)."""
    return sequence_views(user_series(daily, features, user, day, label), length, stride, label_rule)


def mark_spikes(
    daily: DataFrame, measure: str, user: str = "user", quantile: float = 0.9, out: str = "is_spike"
) -> DataFrame:
    """1 where the measure exceeds the user's own quantile (one row a day per user)."""
    limits = daily.groupBy(user).agg(F.percentile(measure, F.lit(quantile)).alias("_limit"))
    joined = daily.join(limits, user)
    return joined.select(
        *[F.col(c) for c in daily.columns],
        F.col("_limit").alias("spike_threshold"),
        (F.col(measure) > F.col("_limit")).cast("int").alias(out),
    )
