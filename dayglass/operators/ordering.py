"""Orderings over whole tables without a single-task window.

Rows are cut into value ranges of about equal size, each range is ordered on
its own, and every range adds the total of the ranges before it. A plain
``Window.orderBy`` (or one partitioned by a handful of models) would put all
rows into one task or a few.

What several passes need is written to the shared folder first, so an input is
planned, and run, once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from dayglass import config
from dayglass.functions.numeric import unit_hash
from dayglass.session import materialise

_SAMPLES_PER_RANGE = 32
_BLOCK = 32


def range_count(df: DataFrame) -> int:
    """Number of value ranges: one per shuffle partition, two at least."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_group_stats(
    df: DataFrame, keys: list[str], aggregates: dict[str, Column], source: DataFrame | None = None
) -> DataFrame:
    """Attach grouped aggregates of ``source`` (default ``df``) to every row.

    With no keys the aggregates are one row and arrive as a scalar subquery. Otherwise
    they are joined on the keys, nulls included; Spark broadcasts them by measured size.
    """
    source = df if source is None else source
    named = [c.alias(n) for n, c in aggregates.items()]
    if keys:
        stats = source.groupBy(*keys).agg(*named).withColumnsRenamed({k: f"_of_{k}" for k in keys})
        match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
        joined = df.join(stats, match, "left")
        return joined.select(*[F.col(c) for c in df.columns], *aggregates)
    found = source.agg(F.struct(*named).alias("s")).scalar()
    # unpacked by a generator, so the plan holds the subquery once and not once per aggregate
    return df.select(*[F.col(c) for c in df.columns], F.inline(F.array(found)))


def _block_heads(points: str) -> Column:
    return F.filter(points, lambda _, i: i % _BLOCK == 0)


def count_below(sorted_array: str, value: Column, or_equal: bool = False) -> Column:
    """How many array elements lie below the value (or at it): find the block, then look inside."""

    def under(x: Column) -> Column:
        return x <= value if or_equal else x < value

    def search(blocks: Column) -> Column:
        before = F.size(F.filter(blocks["heads"], under))
        first = F.greatest(before - 1, F.lit(0)) * _BLOCK
        inside = F.filter(F.slice(blocks["points"], first + 1, _BLOCK), under)
        return first + F.size(inside)

    # one element, bound once: the plan holds the array's subquery a single time
    return F.transform(F.array(F.col(sorted_array)), search)[0]


def _with_range(distinct_keys: DataFrame, df: DataFrame, key: str, ranges: int) -> DataFrame:
    """Add ``_range``: the number of split points below the row's key."""
    numeric = isinstance(df.schema[key].dataType, NumericType)
    if numeric:
        nothing = F.array().cast(f"array<{df.schema[key].dataType.simpleString()}>")
        shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
        found = distinct_keys.agg(
            F.sort_array(
                F.array_distinct(F.coalesce(F.percentile_approx(key, shares), nothing))
            ).alias("points")
        )
        points = found.select(
            F.struct("points", _block_heads("points").alias("heads")).alias("s")
        ).scalar()
    else:
        # a hash-chosen sample of the distinct keys, about _SAMPLES_PER_RANGE per range
        wanted = ranges * _SAMPLES_PER_RANGE
        every = distinct_keys.agg(
            F.greatest(F.lit(1), F.floor(F.approx_count_distinct(key) / F.lit(wanted))).cast("long")
        ).scalar()
        sample = distinct_keys.select(key).where(F.pmod(F.xxhash64(key), every) == 0).distinct()
        array = sample.agg(F.sort_array(F.collect_list(key)).alias("all"))
        step = F.greatest(F.lit(1), F.floor(F.size("all") / F.lit(ranges)).cast("int"))
        cut = array.select("all", step.alias("step")).select(
            F.filter("all", lambda _, i: (i > 0) & (i % F.col("step") == 0)).alias("points")
        )
        points = cut.select(
            F.struct("points", _block_heads("points").alias("heads")).alias("s")
        ).scalar()
    kept = [F.col(c) for c in df.columns]
    bound = df.select(*kept, points.alias("_points"))
    # never null, so a later join adds no null filter that would rerun the search per raw row
    return bound.select(
        *kept, F.coalesce(count_below("_points", F.col(key)), F.lit(0)).alias("_range")
    )


def _range_offsets(
    ranged: DataFrame, within: list[str], sums: list[str], descending: bool
) -> DataFrame:
    """Totals of the ranges before each range: at most ranges x groups rows."""
    order = F.desc("_range") if descending else F.asc("_range")
    group = [F.col(c) for c in within] or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*within, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    return totals.select(
        *[F.col(c).alias(f"_group_{c}") for c in within],
        F.col("_range").alias("_group__range"),
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
    )


def _join_offsets(ranged: DataFrame, offsets: DataFrame, within: list[str]) -> DataFrame:
    """Null-safe join; the offsets are broadcast where their measured size allows."""
    match = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_group_{c}")) for c in [*within, "_range"]],
    )
    return ranged.join(offsets, match)


def running_counts(
    distinct: DataFrame,
    value: str,
    names: list[str],
    within: tuple[str, ...] = (),
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Running totals ``cum_<name>`` over a written table that has each (``within``, value) once."""
    groups = list(within)
    ranged = _with_range(distinct, distinct, value, ranges or range_count(distinct))
    offsets = _range_offsets(ranged, groups, names, descending)
    order = F.desc(value) if descending else F.asc(value)
    running = (
        Window.partitionBy(*groups, "_range")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = _join_offsets(ranged, offsets, groups)
    return joined.select(
        *groups,
        value,
        *names,
        *[(F.sum(n).over(running) + F.col(f"_before_{n}")).alias(f"cum_{n}") for n in names],
    )


def cumulative_counts(
    df: DataFrame,
    value: str,
    sums: dict[str, Column],
    within: tuple[str, ...] = (),
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """One row per distinct value with totals and running totals of ``sums``.

    ``within`` names a small set of groups (models, weight choices). Output:
    ``within``, the value, one column per sum and ``cum_<sum>`` up to and
    including the value. Ties collapse before any ordering, so a value shared
    by a third of all rows costs one row.
    """
    counted = df.groupBy(*within, value).agg(*[c.alias(n) for n, c in sums.items()])
    distinct = materialise(counted, "distinct-values")
    return running_counts(distinct, value, list(sums), within, descending, ranges)


_PLACE_BITS = (1 << 33) - 1  # what monotonically_increasing_id counts inside a partition


def row_numbers(
    df: DataFrame,
    order: list[Column],
    within: tuple[str, ...] = (),
    out: str = "row_number",
    ranges: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Number all rows from 1 in ascending ``order``, restarting per ``within`` group.

    The order must end in a unique key; negate a number for descending order. The rows
    are written once (``stored``: they are a written table already), shuffled once into
    ranges of (group, key), and written again with their place in the range. What a range
    adds is the group's rows in earlier ranges, a table of one row for each range and
    group that meet.
    """
    groups, kept = list(within), [F.col(c) for c in df.columns]
    keys = [c.alias(f"_key{i}") for i, c in enumerate(order)]
    source = df if stored else materialise(df, "numbering-rows")
    keyed = source.select(*kept, *keys)
    by = [*groups, *[f"_key{i}" for i in range(len(order))]]
    ranged = keyed.repartitionByRange(ranges or range_count(df), *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS))
    placed = ranged.select(*kept, F.spark_partition_id().alias("_range"), place.alias("_place"))
    placed = materialise(placed, "numbering-ranges")
    totals = placed.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    group = [F.col(c) for c in groups] or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    offsets = totals.select(
        *[F.col(c).alias(f"_group_{c}") for c in groups], F.col("_range").alias("_group__range"), shift.alias("_shift")
    )
    joined = _join_offsets(placed, offsets, groups)
    return joined.select(*kept, (F.col("_place") + F.col("_shift")).cast("long").alias(out))


# --- exact quantiles --------------------------------------------------------

SKETCH_ACCURACY = 10_000  # ranks of the sketch are off by at most a share 1 / accuracy
_ACCURACY_PER_POINT = 100  # more where many quantiles are asked for at once


def _cells(df: DataFrame, value: str, shares: list[float], groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """Running counts that name every value at which one of the quantiles can lie.

    A mergeable sketch gives each quantile a bracket of values that surely holds it. One
    more pass counts the values: those inside a bracket one by one, those between two
    brackets together, with a null value. Gives the cells (``within``, value, ``n``,
    ``cum_n``) and the totals (``within``, ``_total``). No more values are told apart than
    a share of about 6 / accuracy for each quantile, and all of a group of fewer rows than accuracy.
    """
    accuracy = max(SKETCH_ACCURACY, _ACCURACY_PER_POINT * len(shares))
    rows = materialise(df.select(*groups, F.col(value).alias("_v")).where(F.col("_v").isNotNull()), "quantile-values")
    slack = 3.0 / accuracy
    asked = [max(0.0, p - slack) for p in shares] + [min(1.0, p + slack) for p in shares]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(p) for p in asked]), accuracy)
    m = len(shares)
    found = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_total"), sketch.alias("_points"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    # in a small group a rank is a larger share than the slack: all its values are told apart
    small = F.col("_total") < accuracy
    ends = F.concat(F.array_repeat("_min", m), F.array_repeat("_max", m))
    found = found.withColumn("_points", F.when(small, ends).otherwise(F.col("_points")))

    def blocked(points: Column) -> Column:
        return F.struct(points.alias("points"), F.filter(points, lambda _, i: i % _BLOCK == 0).alias("heads"))

    lows, highs = F.sort_array(F.slice("_points", 1, m)), F.sort_array(F.slice("_points", m + 1, m))
    found = found.select(*groups, "_total", blocked(lows).alias("_low"), blocked(highs).alias("_high"))
    found = materialise(found, "quantile-brackets")
    bound = with_group_stats(rows, groups, {"_low": F.first("_low"), "_high": F.first("_high")}, source=found)
    # brackets that begin at or below the value, and those that end below it
    begun = count_below("_low", F.col("_v"), or_equal=True)
    ended = count_below("_high", F.col("_v"))
    placed = bound.select(*groups, "_v", begun.alias("_begun"), ended.alias("_ended"))
    inside = F.when(F.col("_begun") > F.col("_ended"), F.col("_v"))
    counted = placed.groupBy(*groups, "_begun", inside.alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted, "quantile-cells")
    # between two beginnings values ascend, and what lies outside the brackets comes last
    own = Window.partitionBy(*groups, "_begun").orderBy(F.asc_nulls_last("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = counted.groupBy(*groups, "_begun").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*([F.col(c) for c in groups] or [F.lit(0)])).orderBy("_begun")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(
        *[F.col(c).alias(f"_group_{c}") for c in groups],
        F.col("_begun").alias("_group__begun"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_group_{c}")) for c in [*groups, "_begun"]])
    cells = counted.join(earlier, match).select(
        *groups, F.col("_v").alias(value), "n", (F.sum("n").over(own) + F.col("_before")).alias("cum_n")
    )
    return cells, found.select(*groups, "_total")


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], within: tuple[str, ...] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    A sketch brackets each quantile and only the brackets are counted value by value, so
    neither a buffer nor a table holds every distinct value of a group.
    """
    groups = list(within)
    cells, totals = _cells(df, value, [float(p) for p in probs.values()], groups)
    sized = with_group_stats(cells, groups, {"_total": F.first("_total")}, source=totals)
    parts = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        # a cell without a value here would mean that a bracket missed its quantile
        at = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
        low = F.min_by(at, F.when(F.col("cum_n") > F.floor(position), F.col("cum_n")))
        high = F.min_by(at, F.when(F.col("cum_n") > F.ceil(position), F.col("cum_n")))
        share = F.max(position - F.floor(position))
        parts.append((low + (high - low) * share).alias(name))
    return sized.groupBy(*groups).agg(*parts)


def quantile_grid(df: DataFrame, value: str, steps: int, within: tuple[str, ...] = ()) -> DataFrame:
    """``steps`` evenly spaced quantiles per group as rows (``within``, ``step``, ``quantile``)."""
    groups = list(within)
    last = steps - 1
    cells, totals = _cells(df, value, [i / last for i in range(steps)], groups)
    sized = with_group_stats(cells, groups, {"_total": F.first("_total")}, source=totals)
    # each value answers the steps whose rank it holds; integers keep this exact
    span = F.greatest(F.col("_total") - 1, F.lit(1))

    def answered(first_rank: Column, end_rank: Column, up: bool) -> Column:
        if up:  # ranks are ceil(step * span / last)
            lo = F.floor((first_rank - 1) * last / span) + 1
            hi = F.floor((end_rank - 1) * last / span)
            lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(last))
        else:  # ranks are floor(step * span / last)
            lo = F.ceil(first_rank * last / span)
            hi = F.ceil(end_rank * last / span) - 1
            lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(last))
        return F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long")))

    first, end = F.col("cum_n") - F.col("n"), F.col("cum_n")
    low = sized.select(*groups, "_total", F.col(value).alias("low"), F.explode(answered(first, end, False)).alias("step"))
    high = sized.select(*groups, F.col(value).alias("high"), F.explode(answered(first, end, True)).alias("step"))
    both = low.join(high, groups + ["step"])
    exact = F.col("step") * (F.col("_total") - 1)
    share = (exact % last) / F.lit(float(last))
    return both.select(
        *groups, "step", (F.col("low") + (F.col("high") - F.col("low")) * share).alias("quantile")
    )


def top_rows(
    df: DataFrame, order: list[Column], k: int, within: tuple[str, ...], out: str = "rank", salts: int | None = None
) -> DataFrame:
    """First ``k`` rows per group, ranked from 1.

    The first round ranks inside hash slices of a group, so one group that
    holds most rows still spreads over ``salts`` tasks.
    """
    groups = list(within)
    salts = salts or range_count(df)
    kept = [F.col(c) for c in df.columns]
    salted = df.select(*kept, F.pmod(F.xxhash64(*df.columns), F.lit(salts)).alias("_salt"))
    first = Window.partitionBy(*groups, "_salt").orderBy(*order)
    slices = salted.select(*kept, "_salt", F.row_number().over(first).alias("_slice_rank"))
    final = Window.partitionBy(*groups).orderBy(*order)
    ranked = slices.where(F.col("_slice_rank") <= k).select(
        *kept, F.row_number().over(final).alias(out)
    )
    return ranked.where(F.col(out) <= k)


def _lowest(df: DataFrame, value: str, n: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows below the value that the n-th smallest row has, the rows at it, and how many of those are still wanted."""
    steps = cumulative_counts(df, value, {"_rows": F.count(F.lit(1))})
    reached = steps.where(F.col("cum__rows") >= n)
    cut = reached.agg(F.min(value).alias("at"), F.min(F.col("cum__rows") - F.col("_rows")).alias("before")).first()
    if cut["at"] is None:
        return df, None, 0
    return df.where(F.col(value) < cut["at"]), df.where(F.col(value) == cut["at"]), n - cut["before"]


def hash_sample(df: DataFrame, key: Column, n: int, seed: int | str = config.SEED) -> DataFrame:
    """``n`` rows without replacement, the same ones under any partitioning.

    Rows are drawn in order of a hash of the key, those of one key by a hash of the
    whole row. Running counts of the hashes say where the n-th row lies, so nothing is
    sorted in one task and repeated keys lose nothing. Rows that are equal throughout
    are as good as each other.
    """
    if n <= 0:
        return df.limit(0)
    hashed = df.select("*", unit_hash(key, seed).alias("_h"), F.xxhash64(*df.columns).alias("_row_hash"))
    below, ties, rest = _lowest(hashed, "_h", n)
    if ties is not None:
        first, equal, more = _lowest(ties, "_row_hash", rest)
        below = below.unionByName(first)
        if equal is not None:
            below = below.unionByName(equal.limit(more))
    return below.drop("_h", "_row_hash")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union of frames with unlike columns; missing ones become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
