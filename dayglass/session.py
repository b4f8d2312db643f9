"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


# Skewed joins are split even where that costs one more shuffle behind the join:
# a grouping by (user, day) would otherwise reuse the join's partitioning by user
# and leave a hot user in one task.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "dayglass", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew-join handling, Arrow and a UTC clock.

    Leave ``master`` unset on a cluster; extra settings go in ``conf`` with
    dots written as double underscores.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = RUNTIME_CONF | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``; unset, it is an error
    there. Only a session that runs in one process makes a folder on this machine.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="dayglass-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return f"{base.rstrip('/')}/dayglass/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back.

    Used where several later passes need the same expensive rows: they read a
    table instead of repeating the work, and a lost executor costs no rerun.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
