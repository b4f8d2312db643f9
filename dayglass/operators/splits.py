"""Seeded splits and samples that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass import config
from dayglass.functions.numeric import unit_hash
from dayglass.operators.ordering import hash_sample


def assign_split(
    df: DataFrame,
    key: Column,
    train: float = config.TRAIN_RATIO,
    val: float = config.VAL_RATIO,
    test: float = config.TEST_RATIO,
    seed: int = config.SEED,
    out: str = "split",
) -> DataFrame:
    """Add ``train``, ``val`` or ``test`` by a hash of the key."""
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("ratios must sum to 1")
    u = unit_hash(key, seed)
    return df.withColumn(
        out, F.when(u < train, "train").when(u < train + val, "val").otherwise("test")
    )


def split_normal(
    df: DataFrame, key: Column, label: str, train: float = 0.8, seed: int = config.SEED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normal rows split into training and validation; the test set is everything."""
    normal = df.where(F.coalesce(F.col(label), F.lit(0)) == 0)
    u = unit_hash(key, seed)
    return normal.where(u < train), normal.where(u >= train), df


def cap_rows(df: DataFrame, key: Column, n: int | None, seed: int = config.SEED) -> DataFrame:
    """At most ``n`` rows without replacement; ``None`` keeps all."""
    return df if n is None else hash_sample(df, key, n, seed)


def sample_normals(
    df: DataFrame, key: Column, label: str, n: int, seed: int = config.SEED
) -> DataFrame:
    """``n`` normal rows and every positive row."""
    positive = F.coalesce(F.col(label), F.lit(0)) > 0
    return hash_sample(df.where(~positive), key, n, seed).unionByName(df.where(positive))
