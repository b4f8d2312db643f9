"""Stored moments: count, mean and centred square sum per group, which merge.

A table of moments stands for all rows behind it. Moments of disjoint parts merge by
Chan's rule without going back to the rows, so a new day costs that day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.operators.ordering import union_all
from dayglass.session import materialise


def moments(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Written table: ``keys`` and per measure a struct (``n``, ``mean``, ``m2``) of its non-null values."""
    parts = []
    for m in measures:
        x = F.col(m).cast("double")
        n = F.count(x)
        # without rows there is no variance; with one the square sum is 0
        m2 = F.coalesce(F.var_pop(x) * n, F.lit(0.0))
        parts.append(F.struct(n.alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), m2.alias("m2")).alias(m))
    return materialise(df.groupBy(*keys).agg(*parts), "moments")


def _chan(a: Column, b: Column) -> Column:
    """Moments of two parts together."""
    n = a["n"] + b["n"]
    gap, share = b["mean"] - a["mean"], F.coalesce(F.try_divide(b["n"].cast("double"), n.cast("double")), F.lit(0.0))
    return F.struct(
        n.alias("n"),
        (a["mean"] + gap * share).alias("mean"),
        (a["m2"] + b["m2"] + gap * gap * a["n"] * share).alias("m2"),
    )


def merge_moments(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Moments of all rows behind the tables; a group has at most one part in each table."""
    measures = [c for c in tables[0].columns if c not in keys]
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    # sorted, so the result does not depend on the order in which parts arrive
    merged = [F.aggregate(F.sort_array(F.collect_list(m)), nothing, _chan).alias(m) for m in measures]
    return materialise(union_all(tables).groupBy(*keys).agg(*merged), "moments")


def sample_std(of: Column) -> Column:
    """Sample standard deviation from moments; null for fewer than two values."""
    return F.when(of["n"] > 1, F.sqrt(of["m2"] / (of["n"] - 1)))
