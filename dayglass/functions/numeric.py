"""Numeric columns: ratios, labels, hashes, array search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dayglass import config


def guarded_ratio(part: Column, whole: Column) -> Column:
    """Share with the small constant in the denominator that avoids division by zero."""
    return part / (whole + F.lit(config.EPSILON))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """``(x - mean) / (std + 1e-10)`` with a null std read as 0 and infinities as 0."""
    z = (x - mean) / (F.coalesce(std, F.lit(0.0)) + F.lit(config.EPSILON))
    return finite_or_zero(z)


def finite_or_zero(x: Column) -> Column:
    """Infinities become 0; NaN and null stay."""
    return F.when(F.abs(x) == F.lit(float("inf")), F.lit(0.0)).otherwise(x)


def binary_label(y: Column) -> Column:
    """Null and unreadable labels become 0, anything above 0 becomes 1."""
    return F.when(F.coalesce(y.try_cast("double"), F.lit(0.0)) > 0, 1).otherwise(0)


def above(score: Column, threshold: Column | float, inclusive: bool = False) -> Column:
    """Threshold flag, strict unless ``inclusive``."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return ((score >= limit) if inclusive else (score > limit)).cast("int")


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1]; a range below 1e-10 gives 0."""
    span = high - low
    return F.when(span < config.EPSILON, F.lit(0.0)).otherwise((x - low) / span)


def mean_abs(columns: list[Column]) -> Column:
    """Mean absolute value over columns of one row, nulls read as 0."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.abs(F.coalesce(c.cast("double"), F.lit(0.0)))
    return total / F.lit(float(len(columns)))


def unit_hash(key: Column, seed: int | str = config.SEED) -> Column:
    """Number in [0, 1) that depends only on seed and key, not on partitioning."""
    digest = F.md5(F.concat(F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
