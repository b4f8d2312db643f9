"""Test tables as an activity log: the mapping described in FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def user_code(number: Column) -> Column:
    return F.concat(F.lit("U"), F.lpad(number.cast("string"), 6, "0"))


# Event type to activity and to log kind.
ACTIVITY = {
    "signup": "Logon",
    "error": "Logoff",
    "purchase": "Connect",
    "view": "File Open",
    "click": "http",
}
KIND = {
    "signup": "logon",
    "error": "logon",
    "purchase": "device",
    "view": "file",
    "click": "http",
}


def _decode(column: Column, mapping: dict[str, str]) -> Column:
    out = None
    for key, value in mapping.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ``id, date, user_id, pc_id, activity, activity_type, dataset, size``."""
    events = table(spark, sf_dir, "events")
    number = F.col("user_id")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("date"),
        user_code(number).alias("user_id"),
        F.concat(F.lit("PC"), F.get_json_object("props", "$.k")).alias("pc_id"),
        _decode(F.col("event_type"), ACTIVITY).alias("activity"),
        _decode(F.col("event_type"), KIND).alias("activity_type"),
        F.concat(F.lit("r"), (1 + number % 2).cast("string")).alias("dataset"),
        (F.col("value") * 10240).cast("long").alias("size"),
    )


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User roles from the customers' market segments."""
    return table(spark, sf_dir, "customer").select(
        user_code(F.col("c_custkey")).alias("user_id"), F.col("c_mktsegment").alias("role")
    )


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trait scores derived from customer columns."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        user_code(key).alias("user_id"),
        *[(key * (i + 3) % 50).cast("int").alias(c) for i, c in enumerate("OCEAN"[:5])],
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping windows for every user whose number is 7 modulo 50."""
    users = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 50 == 7)
    spans = F.array(
        F.struct(
            F.lit("2024-01-10 00:00:00").alias("start"), F.lit("2024-01-12 23:59:59").alias("end")
        ),
        F.struct(
            F.lit("2024-01-12 00:00:00").alias("start"), F.lit("2024-01-14 12:00:00").alias("end")
        ),
    )
    rows = users.select(F.col("c_custkey").alias("n"), F.explode(spans).alias("w"))
    return rows.select(
        user_code(F.col("n")).alias("user_id"),
        F.concat(F.lit("r"), (1 + F.col("n") % 2).cast("string")).alias("dataset"),
        F.col("w.start").cast("timestamp_ntz").alias("start"),
        F.col("w.end").cast("timestamp_ntz").alias("end"),
    )
