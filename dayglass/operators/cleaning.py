"""Deduplication, missing values, unions of unlike logs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from dayglass import config
from dayglass.operators.ordering import quantiles, row_numbers
from dayglass.session import materialise


def drop_unparsed_dates(df: DataFrame, ts: str = "date") -> DataFrame:
    return df.where(F.col(ts).isNotNull())


def keep_one(df: DataFrame, keys: list[str], order: list[Column], keep: str) -> DataFrame:
    """One row per key: the first or last in ``order``.

    An aggregate with partial results on the map side, so a key with very many
    rows does not gather in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    # nulls would be skipped by the comparison, so presence is part of the order
    ranked = F.struct(*[x for c in order for x in (c.isNotNull(), c)])
    chosen = pick(F.struct(*rest), ranked).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_row.*")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def null_counts(df: DataFrame) -> DataFrame:
    """One row with the number of nulls of every column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def fill_missing(
    df: DataFrame, strategy: str = "drop", columns: Iterable[str] | None = None
) -> DataFrame:
    """``drop``, ``fill_mean``, ``fill_median`` (numeric columns) or ``fill_mode`` (all).

    The mode is the most frequent value, the smallest one on ties. An integer
    column filled with a mean or median becomes double; name the ``columns`` to
    leave others as they are.
    """
    if strategy == "drop":
        return df.na.drop()
    chosen = list(columns) if columns else (df.columns if strategy == "fill_mode" else _numeric(df))
    if strategy == "fill_mean":
        # one row of means, one pass
        means = df.agg(*[F.avg(c).alias(c) for c in chosen]).first()
        fills = {c: F.lit(means[c]) for c in chosen}
    elif strategy == "fill_median":
        # one row of medians, all columns in one pass each of sketch and counts
        long = _unpivoted(df, chosen, "double")
        medians = {r["_column"]: r["m"] for r in quantiles(long, "_value", {"m": 0.5}, ("_column",)).collect()}
        fills = {c: F.lit(medians.get(c)) for c in chosen}
    elif strategy == "fill_mode":
        modes = modes_of(df, chosen).first()
        fills = {c: F.lit(modes[c]).cast(df.schema[c].dataType) for c in chosen}
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return df.select(
        *[F.coalesce(F.col(c), fills[c]).alias(c) if c in fills else F.col(c) for c in df.columns]
    )


def _unpivoted(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(``_column``, ``_value``) of all non-null cells, cast to one type."""
    cells = [F.struct(F.lit(c).alias("_column"), F.col(c).cast(kind).alias("_value")) for c in columns]
    return df.select(F.inline(F.array(*cells))).where(F.col("_value").isNotNull())


def modes_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with each column's most frequent value, the smallest one on ties; null where all are.

    Cells become (column, value) and are counted in one pass, however many columns there
    are. A value travels in a slot of its own type, so it compares as it does at home.
    """
    kinds = sorted({df.schema[c].dataType.simpleString() for c in columns})
    slot = {k: f"_slot{i}" for i, k in enumerate(kinds)}

    def cell(place: int, name: str) -> Column:
        own = df.schema[name].dataType.simpleString()
        held = [(F.col(name) if k == own else F.lit(None)).cast(k).alias(slot[k]) for k in kinds]
        return F.struct(F.lit(place).alias("_column"), F.col(name).isNotNull().alias("_there"), *held)

    cells = df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)]))).where("_there")
    counted = cells.groupBy("_column", *slot.values()).agg(F.count(F.lit(1)).alias("_n"))
    value = F.struct(*slot.values())
    first = F.struct(-F.col("_n"), *slot.values())

    def mode(place: int, name: str) -> Column:
        mine = F.col("_column") == place
        best = F.min_by(F.when(mine, value), F.when(mine, first))
        return best[slot[df.schema[name].dataType.simpleString()]].alias(name)

    return counted.agg(*[mode(i, c) for i, c in enumerate(columns)])


def fill_by_type(df: DataFrame, text: str = "UNKNOWN") -> DataFrame:
    """Numeric nulls become 0, text nulls become ``UNKNOWN``."""
    return df.na.fill(0, _numeric(df)).na.fill(
        text, [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    )


def fill_log_defaults(df: DataFrame) -> DataFrame:
    """Role ``UNKNOWN``, traits and flags 0; role and traits are created when absent."""
    columns = {}
    present = df.columns
    role = F.coalesce(F.col("role"), F.lit("UNKNOWN")) if "role" in present else F.lit("UNKNOWN")
    columns["role"] = role
    for c in config.TRAITS:
        columns[c] = F.coalesce(F.col(c), F.lit(0)) if c in present else F.lit(0)
    for c in config.FLAG_COLUMNS:
        if c in present:
            columns[c] = F.coalesce(F.col(c), F.lit(0).cast("byte"))
    if "email_size_kb" in present:
        columns["email_size_kb"] = F.coalesce(F.col("email_size_kb"), F.lit(0.0))
    return df.withColumns(columns)


def align_columns(df: DataFrame, layout: dict[str, str], fills: dict[str, object] | None = None) -> DataFrame:
    """Add the layout's missing columns as typed nulls (or fills) and put it first in order."""
    fills = fills or {}
    out = []
    for name, kind in layout.items():
        column = F.col(name) if name in df.columns else F.lit(None).cast(kind)
        if name in fills:
            column = F.coalesce(column, F.lit(fills[name]).cast(kind))
        out.append(column.alias(name))
    return df.select(*out, *[c for c in df.columns if c not in layout])


def one_hot(df: DataFrame, column: str, categories: Iterable[str]) -> DataFrame:
    """One 0/1 column per category plus one for null, replacing the column."""
    flags = {
        f"{column}_{c}": F.coalesce(F.col(column) == c, F.lit(False)).cast("int") for c in categories
    }
    flags[f"{column}_nan"] = F.col(column).isNull().cast("int")
    return df.withColumns(flags).drop(column)


MAX_CATEGORIES = 1_000  # columns that a one-hot table may get


def categories_of(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list[str]:
    """Sorted category names for ``one_hot``, which makes a column of each; more than ``limit`` are refused."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} categories: use category_dictionary and category_index")
    return sorted(r[0] for r in found)


def category_dictionary(df: DataFrame, column: str) -> DataFrame:
    """Written table ``category, index`` of all categories in ascending order, indexed from 0; any number of them."""
    distinct = df.select(F.col(column).alias("category")).where(F.col("category").isNotNull()).distinct()
    numbered = row_numbers(distinct, [F.col("category")], out="index")
    return materialise(numbered.withColumn("index", F.col("index") - 1), "categories")


def category_index(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Replace the column by ``<column>_index``, the place of the single 1 in its one-hot row.

    Null and what the dictionary does not have get the place after the last, the null
    category of ``one_hot``. The dictionary is joined, broadcast where its size allows.
    """
    last = dictionary.agg(F.count(F.lit(1))).scalar()
    known = dictionary.select(F.col("category").alias("_category"), F.col("index").alias("_index"))
    joined = df.join(known, F.col(column) == F.col("_category"), "left")
    kept = [F.col(c) for c in df.columns if c != column]
    return joined.select(*kept, F.coalesce("_index", last).alias(f"{column}_index"))


def add_pseudonym(df: DataFrame, column: str) -> DataFrame:
    from dayglass.functions.text import pseudonym

    return df.withColumn(f"{column}_pseudo", pseudonym(F.col(column)))
