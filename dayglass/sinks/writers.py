"""Stage outputs: Parquet inside, CSV and JSON at the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.operators.windows import sequence_views

# CSV keeps microseconds; the default layouts would cut them to milliseconds
CSV_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
}


def write_unified_log(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Unified log partitioned by dataset, so readers of one dataset skip the others."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(header=True, **CSV_TIMES).csv(path)
    else:
        writer.partitionBy("dataset").parquet(path)


def write_profile(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(header=True, **CSV_TIMES).csv(path)


def write_sequences(series: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Series of all users, from which sequences are cut as they are read; none gives an empty typed table."""
    series.write.mode(mode).parquet(path)


def read_sequences(spark: SparkSession, path: str, **views: object) -> DataFrame:
    """Sequences of written series; ``views`` as for ``sequence_views``."""
    return sequence_views(spark.read.parquet(path), **views)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Keyed predictions, one folder per model."""
    df.write.mode(mode).partitionBy("model").parquet(path)


def write_ensemble(
    scored: DataFrame, alerts: DataFrame, comparison: DataFrame, path: str, mode: str = "overwrite"
) -> None:
    scored.write.mode(mode).parquet(f"{path}/predictions")
    alerts.write.mode(mode).parquet(f"{path}/alerts")
    comparison.write.mode(mode).parquet(f"{path}/comparison")


def write_params(params: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fitted parameters (scaler, thresholds) as a table."""
    params.write.mode(mode).parquet(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def next_version(spark: SparkSession, base: str) -> str:
    """Path of the next version folder below ``base`` (``v1``, ``v2`` ...)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(base)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(hadoop.Path(folder, "v*")) or []
    taken = [int(s.getPath().getName()[1:]) for s in found if s.getPath().getName()[1:].isdigit()]
    return f"{base}/v{max(taken, default=0) + 1}"


def rewrite_predictions(df: DataFrame, base: str, thresholds: DataFrame) -> str:
    """Predictions under new thresholds (``model, threshold``), written as a new version.

    The input may be the latest version, so it is never overwritten.
    """
    path = next_version(df.sparkSession, base)
    limit = thresholds.select(F.col("model").alias("_model"), F.col("threshold").alias("_t"))
    changed = df.join(limit, F.col("model").eqNullSafe(F.col("_model")), "left").drop("_model")
    renewed = changed.withColumn(
        "prediction",
        F.when(F.col("_t").isNull(), F.col("prediction")).otherwise(
            (F.col("anomaly_score") > F.col("_t")).cast("int")
        ),
    ).drop("_t")
    write_predictions(renewed, path)
    return path
