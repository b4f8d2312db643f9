"""Stage tables and prediction tables."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass import config
from dayglass.sinks.writers import CSV_TIMES


def scan_table(
    spark: SparkSession, path: str, schema: str | None = None, columns: Iterable[str] | None = None
) -> DataFrame:
    """Parquet or CSV by suffix, pruned to ``columns``.

    The selection reaches the Parquet scan, which then reads nothing else.
    """
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.options(header=True, **CSV_TIMES)
        df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def peek(df: DataFrame, n: int, order: Iterable[str] = ()) -> DataFrame:
    """First ``n`` rows, by key order when one is given."""
    return (df.orderBy(*order) if order else df).limit(n)


def read_predictions(
    spark: SparkSession, path: str, models: Iterable[str] = config.MODELS
) -> DataFrame:
    """Prediction table partitioned by model; a model without rows only warns."""
    table = spark.read.parquet(path)
    wanted = list(models)
    # the listing the reader has made already names the folders; no row is read
    present = {unquote(unquote(f)).rsplit("/model=", 1)[-1].split("/")[0] for f in table.inputFiles() if "/model=" in f}
    for model in wanted:
        if model not in present:
            warnings.warn(f"no predictions of {model}", stacklevel=2)
    return table.where(F.col("model").isin(*wanted))


def resolve_prediction_columns(raw: DataFrame) -> DataFrame:
    """``user_id, label, score`` from any accepted spelling of those columns."""
    named = {c.lower().strip(): c for c in raw.columns}

    def pick(aliases: tuple[str, ...], what: str) -> Column:
        for alias in aliases:
            if alias in named:
                return F.col(f"`{named[alias]}`")
        raise ValueError(f"no {what} column among {raw.columns}")

    return raw.select(
        pick(config.USER_ALIASES, "user").alias("user_id"),
        pick(config.LABEL_ALIASES, "label").alias("label"),
        pick(config.SCORE_ALIASES, "score").alias("score"),
    )
