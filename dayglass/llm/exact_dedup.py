"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Only columns of the DataFrame API; no Python runs on the executors.

Defined results: a null text counts as empty, and empty texts equal each other. A null
id loses against any other id. Rows that repeat both id and text are one document: they
give one result row, and ``group_size`` counts them all. An empty table gives no rows.
Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.common import broadcast_if_small, packed, unpacked, with_marks
from dayglass.session import materialise

PREFIX = 256  # characters


def _length(text: Column) -> Column:
    return F.octet_length(text)


def _survivors(texts: DataFrame, prefix_chars: int) -> DataFrame:
    """Written table of ``_key``, a hash of (length, prefix hash) that several rows have.

    Lengths are counted first. The prefix is hashed only where another row has the length.
    """
    sized = texts.select(_length(F.col("_text")).alias("_length"), F.substring("_text", 1, prefix_chars).alias("_start"))
    counts = sized.groupBy("_length").agg(F.count(F.lit(1)).alias("_n"))
    lengths = materialise(counts.where("_n > 1").select("_length"), "exact-lengths")
    met = sized.join(broadcast_if_small(lengths), "_length", "left_semi")
    signed = met.groupBy(_signature(F.col("_length"), F.col("_start")).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return materialise(signed.where("_n > 1").select("_key"), "exact-signatures")


def _signature(length: Column, start: Column) -> Column:
    return F.xxhash64(length, start)


def _with_candidates(rows: DataFrame, prefix_chars: int) -> DataFrame:
    """Add ``_marked`` to rows with ``_text``: whether length and prefix may be another row's as well."""
    key = _signature(_length(F.col("_text")), F.substring("_text", 1, prefix_chars))
    return with_marks(rows, key, _survivors(rows, prefix_chars))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX,
    digest_all: bool = False,
) -> DataFrame:
    """One row per document: id, ``keep_id`` (largest id of its group), ``group_size``, ``kept``, ``rows`` (that repeat it), ``text_sha256``.

    What shares length and prefix with another row is marked in a bitmap of fixed size, so
    the last pass tells candidates apart as it reads and no text is ever shuffled. A
    wrongly marked text merely gets hashed; the full hash decides. Texts without a
    candidate have a null digest unless ``digest_all`` is set.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = _with_candidates(keyed, prefix_chars).withColumnRenamed("_marked", "_candidate")
    digest = F.sha2(F.col("_text").cast("binary"), 256)
    signed = found.select(
        "_id",
        _length(F.col("_text")).alias("_length"),
        "_candidate",
        (digest if digest_all else F.when(F.col("_candidate"), digest)).alias("_digest"),
    )
    signed = materialise(signed, "exact-digests")
    singles = signed.where(~F.col("_candidate")).select(
        F.col("_id").alias(id_col),
        F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lit(1).cast("long").alias("rows"),
        F.col("_digest").alias("text_sha256"),
    )
    same = ["_length", "_digest"]
    # repeated rows collapse first, then each group to one row
    members = signed.where("_candidate").groupBy("_id", *same).agg(F.count(F.lit(1)).alias("_rows"))
    groups = members.groupBy(*same).agg(F.max("_id").alias("keep_id"), F.sum("_rows").alias("group_size"))
    # written, so that the join may split a group that holds very many rows
    members, groups = materialise(members, "exact-members"), materialise(groups, "exact-group-sizes")
    grouped = members.join(groups, same).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_rows").alias("rows"),
        F.col("_digest").alias("text_sha256"),
    )
    return singles.unionByName(grouped)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX) -> DataFrame:
    """The documents that stay, all their columns; of rows repeating id and text, one stays.

    A text without a candidate passes as it is read; the others meet their group's verdict.
    """
    rows = packed(docs, id_col, text_col).withColumn("_text", F.coalesce("_text", F.lit("")))
    found = _with_candidates(rows, prefix_chars)
    alone, candidates = found.where(~F.col("_marked")), found.where("_marked")
    digest = F.sha2(F.col("_text").cast("binary"), 256)
    signed = materialise(candidates.select("_id", digest.alias("_digest")), "exact-digests")
    members = signed.groupBy("_id", "_digest").agg(F.count(F.lit(1)).alias("rows"))
    groups = members.groupBy("_digest").agg(F.max("_id").alias("keep_id"))
    members, groups = materialise(members, "exact-members"), materialise(groups, "exact-group-sizes")
    kept = members.join(groups, "_digest").where(F.col("_id").eqNullSafe(F.col("keep_id")))
    verdict = kept.select(F.col("_id").alias("_verdict_id"), F.col("_digest").alias("_sha"), "rows")
    same = F.col("_id").eqNullSafe(F.col("_verdict_id")) & (F.col("_digest") == F.col("_sha"))
    # verdicts grow with the documents: always a shuffled join
    joined = candidates.withColumn("_digest", digest).join(verdict.hint("merge"), same)
    once = joined.where("rows = 1")
    repeated = joined.where("rows > 1").dropDuplicates(["_id", "_digest"])
    return unpacked(alone).unionByName(unpacked(once)).unionByName(unpacked(repeated))
