"""Standard and min-max scaling with parameters kept as a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.functions.numeric import min_max
from dayglass.operators.ordering import with_group_stats
from dayglass.session import materialise


def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature, mean, scale`` rows: population std, 1 for a constant feature.

    One pass over the data, then one row is turned into one row per feature.
    """
    stats = df.agg(
        *[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"m{i}").alias("mean"),
                F.when(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) == 0, F.lit(1.0))
                .otherwise(F.col(f"s{i}"))
                .alias("scale"),
            )
            for i, f in enumerate(features)
        ]
    )
    return stats.select(F.inline(rows))


def apply_scaler(df: DataFrame, params: DataFrame, features: list[str]) -> DataFrame:
    """``(x - mean) / scale`` for every feature, other columns untouched.

    The parameters, one row per feature, are read once and become constants of
    the plan, as those of a fitted model do.
    """
    rows = params.where(F.col("feature").isin(*features)).limit(len(features)).collect()
    known = {p["feature"]: (p["mean"], p["scale"]) for p in rows}

    def scaled(c: str) -> Column:
        mean, width = known[c]
        return ((F.col(c).cast("double") - F.lit(mean)) / F.lit(width)).alias(c)

    return df.select(*[scaled(c) if c in features else F.col(c) for c in df.columns])


def scale(df: DataFrame, features: list[str], params: DataFrame | None = None) -> DataFrame:
    """Scale with stored parameters, or fit on the data when their features differ.

    The parameter table has one row per feature, so reading its names is small.
    """
    if params is not None:
        known = {r["feature"] for r in params.select("feature").limit(len(features) + 1).collect()}
        if known != set(features):
            params = None
    return apply_scaler(df, fit_scaler(df, features) if params is None else params, features)


def scaled_with_parameters(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """All columns but the keys scaled by parameters of their own, and those parameters to store.

    The table is read twice, for the parameters and when the result is used: pass a written one.
    """
    features = [c for c in df.columns if c not in keys]
    params = materialise(fit_scaler(df, features), "scaler")
    return apply_scaler(df, params, features), params


def normalise(
    df: DataFrame, column: str, within: tuple[str, ...] = (), out: str | None = None
) -> DataFrame:
    """Min-max to [0, 1] over the table or per small group; a range below 1e-10 gives 0."""
    found = with_group_stats(df, list(within), {"_low": F.min(column), "_high": F.max(column)})
    scaled = min_max(F.col(column), F.col("_low"), F.col("_high"))
    return found.withColumn(out or column, scaled).drop("_low", "_high")
