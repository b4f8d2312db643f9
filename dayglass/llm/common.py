"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rows below which a side of a join may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table behind a count of its rows; leave it to a shuffle join beyond."""
    return F.broadcast(df) if df.count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` does the same, and faster, where a text is plain ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole rows in ``_row`` beside ``_id`` and ``_text``: no column of theirs clashes with ours."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


_MARK_BITS = 32_768  # of one value of bitmap_construct_agg
MARK_WORDS = 1_024  # of 4 KB each: a broadcast bitmap holds 4 MB at most


def with_marks(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """Add ``_marked``: true wherever the key is among the ``_key`` values of ``wanted``, and for some others.

    The values set bits of a bitmap of fixed size, which is broadcast whatever their
    number: rows are told apart as they are read, and what is not marked need not be
    shuffled to meet them. The fuller the bitmap, the more rows are marked for nothing.
    """
    size = MARK_WORDS * _MARK_BITS

    def placed(of: Column) -> tuple[Column, Column]:
        bit = F.pmod(F.xxhash64(of), F.lit(size))
        return F.floor(bit / _MARK_BITS), bit % _MARK_BITS

    word, at = placed(F.col("_key"))
    bitmap = wanted.select(word.alias("_word"), at.alias("_at")).groupBy("_word").agg(F.bitmap_construct_agg("_at").alias("_marks"))
    word, at = placed(key)
    found = rows.withColumns({"_word": word, "_at": at}).join(F.broadcast(bitmap), "_word", "left")
    byte = F.conv(F.hex(F.expr("substring(_marks, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("long")
    marked = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    return found.withColumn("_marked", marked).drop("_word", "_at", "_marks")


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite entries."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def floored(vector: Column, scale: int, shift: int = 0) -> Column:
    """A vector's entries as the integers floor(scale * entry) + shift, computed from doubles."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)


def held_out(key: Column) -> Column:
    """Rows whose labels are kept from fitting: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Few rows to an Arrow batch, so that very long texts fit into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_by_worker() -> dict:
    """What a reused Python worker keeps from task to task: loaded vocabularies, look-up tables."""
    return sys.modules.setdefault("_dayglass_kept", types.ModuleType("_dayglass_kept")).__dict__


def hand_back() -> None:
    """Return a worker's freed memory to the system, where its C library can: a reused worker would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
