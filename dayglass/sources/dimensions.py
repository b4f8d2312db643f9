"""Directory attributes, trait scores, ground truth and user lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass import config
from dayglass.functions import text
from dayglass.operators.cleaning import keep_one
from dayglass.operators.ordering import union_all


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_directory(spark: SparkSession, files: Iterable[str]) -> DataFrame:
    """Latest role (and domain) per user over dated directory files.

    Files without a ``role`` column are skipped. "Latest" is the greatest file
    name, then the greatest row. The directory's ``domain`` is renamed
    ``user_domain`` so that it cannot clash with the host of a URL.
    """
    frames = []
    for path in files:
        raw = _csv(spark, path)
        if "role" not in raw.columns:
            continue
        wanted = ["user_id", "role"] + (["domain"] if "domain" in raw.columns else [])
        frames.append(raw.select(*wanted, F.col("_metadata.file_path").alias("_file")))
    if not frames:
        raise FileNotFoundError("no directory file has a role column")
    rows = union_all(frames)
    if "domain" in rows.columns:
        rows = rows.withColumnRenamed("domain", "user_domain")
    values = [c for c in rows.columns if c not in ("user_id", "_file")]
    latest = keep_one(rows, ["user_id"], [F.col("_file"), *[F.col(c) for c in values]], "last")
    return latest.select("user_id", *values)


def read_traits(spark: SparkSession, files: Iterable[str]) -> DataFrame:
    """First trait scores per user over files in name order."""
    frames = [
        _csv(spark, path).withColumn("_file", F.col("_metadata.file_path")) for path in files
    ]
    rows = union_all(frames)
    values = [c for c in config.TRAITS if c in rows.columns]
    typed = rows.select("user_id", *[F.col(c).try_cast("int").alias(c) for c in values], "_file")
    first = keep_one(typed, ["user_id"], [F.col("_file"), *[F.col(c) for c in values]], "first")
    return first.select("user_id", *values)


def incident_windows(raw: DataFrame, datasets: Iterable[str], dataset_id: Column | None = None) -> DataFrame:
    """Closed time windows of known incidents in the datasets being processed.

    ``raw`` has ``dataset, user, start, end``; rows whose times do not parse are
    dropped. ``dataset_id`` sets how raw dataset names are normalised.
    """
    named = dataset_id if dataset_id is not None else text.prefixed_dataset_id(F.col("dataset"))
    kept = raw.select(
        F.col("user").cast("string").alias("user_id"),
        named.alias("dataset"),
        text.parse_activity_time(F.col("start")).alias("start"),
        text.parse_activity_time(F.col("end")).alias("end"),
        *([F.col("scenario")] if "scenario" in raw.columns else []),
    )
    return kept.where(
        F.col("dataset").isin(*datasets) & F.col("start").isNotNull() & F.col("end").isNotNull()
    )


def read_incidents(spark: SparkSession, path: str, datasets: Iterable[str]) -> DataFrame:
    return incident_windows(_csv(spark, path), datasets)


def read_user_list(spark: SparkSession, path: str) -> DataFrame:
    """User ids, one per line, trimmed, blank lines dropped."""
    ids = spark.read.text(path).select(F.trim("value").alias("user_id"))
    return ids.where(F.col("user_id") != "")
