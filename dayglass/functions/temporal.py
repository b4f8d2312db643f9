"""Calendar and shift columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Hour, weekday (Monday is 0), day, month, weekend and business-hours flags."""
    hour = F.hour(ts)
    weekday = F.weekday(ts)
    return {
        "hour": hour,
        "day_of_week": weekday,
        "day_of_month": F.day(ts),
        "month": F.month(ts),
        "is_weekend": weekday.isin(5, 6).cast("int"),
        "is_business_hours": hour.between(9, 17).cast("int"),
    }


def shift_columns(ts: Column) -> dict[str, Column]:
    """Night (22-6, across midnight), early-morning (0-6) and late (20-23) flags."""
    hour = F.hour(ts)
    return {
        "is_night_shift": ((hour >= 22) | (hour <= 6)).cast("int"),
        "is_early_morning": hour.between(0, 6).cast("int"),
        "is_late_night": hour.between(20, 23).cast("int"),
    }


def add_calendar(df: DataFrame, ts: str = "date", shifts: bool = False) -> DataFrame:
    columns = calendar_columns(F.col(ts))
    if shifts:
        columns |= shift_columns(F.col(ts))
    return df.withColumns(columns)


def day_from_index(index: Column, base: str = "2024-01-01") -> Column:
    """Date that lies ``index`` days after the base date."""
    return F.date_add(F.lit(base).cast("date"), index.cast("int"))
