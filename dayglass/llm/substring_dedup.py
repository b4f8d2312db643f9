"""Substring dedup by hashing units of text: of equal units the earliest ranked one stays.

Two forms share the method: units are normalised (words, lower-cased and joined by single
spaces), their digests are grouped over all documents, combined before the shuffle, and
units are ranked by id, then by place.

``passage_dedup`` takes sentences and lines as units and removes runs of neighbouring
repeated units that hold enough words together, with the original offsets of each run. A
passage that many documents share goes wherever it stands, also inside a longer line,
while short sentences that are common by chance stay: a unit below ``min_words`` neither
breaks a run nor counts in it. Eight letters count as a word at least, so that writing
without spaces counts by its length.

``line_dedup`` takes whole lines of ``min_words`` words or more, each on its own.

Defined results: a null or empty text has no unit. Null ids rank last. Rows that repeat
an id rank alike, so what they alone share stays in each; what goes is told by id and
text. Whole texts are read, however long, and their work grows with their length; the
units of one document meet in one row. An empty table gives no rows. Columns other
than the id and the text pass through ``drop_repeated`` and ``drop_passages`` untouched.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from dayglass.llm.common import packed, small_batches
from dayglass.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def line_units(text: str | None, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(line number, start, length, digest) of the lines long enough; offsets in code points."""
    start = 0
    for number, line in enumerate((text or "").split("\n")):
        words = _WORD.findall(line.encode("utf-8", "surrogatepass").lower())
        if len(words) >= min_words:
            yield number, start, len(line), hashlib.blake2b(b" ".join(words), digest_size=16).digest()
        start += len(line) + 1


def repeated_units(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Units to remove: (``_id``, ``_hash`` of the text, ``_line``, ``_start``, ``_length``, ``_first`` the id that keeps the line)."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    schema = StructType(
        [
            source.schema["_id"],
            StructField("_hash", LongType()),
            StructField("_line", IntegerType()),
            StructField("_start", LongType()),
            StructField("_length", LongType()),
            StructField("_digest", BinaryType()),
        ]
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, h, *u) for k, h, t in zip(batch["_id"], batch["_hash"], batch["_text"]) for u in line_units(t, min_words)]
            yield pd.DataFrame(rows, columns=schema.names)

    units = materialise(source.mapInPandas(cut, schema), "line-units")
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_line").alias("line"))
    first = units.groupBy("_digest").agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("_n"))
    shared = first.where("_n > 1").drop("_n")
    met = units.join(shared, "_digest").where(~rank.eqNullSafe(F.col("_first")))
    return met.select("_id", "_hash", "_line", "_start", "_length", F.col("_first.id").alias("_first"))


def line_dedup(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents: ``_row``, ``_id``, ``_text``, ``_cleaned`` and ``_removed`` (line, start, length, first id)."""
    again = materialise(repeated_units(docs, min_words, id_col, text_col).distinct(), "line-repeats")
    part = F.struct(
        F.col("_line").alias("line"), F.col("_start").alias("start"), F.col("_length").alias("length"), F.col("_first").alias("first")
    )
    # the lines of one document
    removed = again.groupBy(F.col("_id").alias("_cut"), F.col("_hash").alias("_cut_hash")).agg(F.sort_array(F.collect_list(part)).alias("_removed"))
    same = F.col("_id").eqNullSafe(F.col("_cut")) & (F.xxhash64("_text") == F.col("_cut_hash"))
    joined = packed(docs, id_col, text_col).join(removed, same, "left")
    gone = F.map_from_arrays("_removed.line", "_removed.length")
    lines = F.filter(F.split("_text", "\n", -1), lambda _, i: ~F.map_contains_key(gone, i))
    cleaned = F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(F.array_join(lines, "\n"))
    return joined.withColumn("_cleaned", cleaned).drop("_cut", "_cut_hash")


def drop_repeated(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with their repeated lines removed."""
    done = line_dedup(docs, min_words, id_col, text_col)
    return done.select(*[F.col("_cleaned").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


# --- passages ---------------------------------------------------------------------------

# Sentence and line ends; a unit takes its own along, so units tile the text.
_UNIT = re.compile(r"[^.!?\n\u3002\uff01\uff1f]*[.!?\n\u3002\uff01\uff1f]+|[^.!?\n\u3002\uff01\uff1f]+")
MIN_WORDS, RUN_WORDS = 3, 20
_LETTERS = 8  # that count as one word at least


def passage_units(text: str | None) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, words) of the units that have a word; offsets in code points."""
    for found in _UNIT.finditer(text or ""):
        words = _WORD.findall(found.group().encode("utf-8", "surrogatepass").lower())
        if words:
            yield found.start(), found.end(), words


def _weight(words: list[bytes]) -> int:
    letters = sum(len(w.decode("utf-8", "surrogatepass")) for w in words)
    return max(len(words), letters // _LETTERS)


def repeated_runs(
    docs: DataFrame, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Runs to remove: (``_id``, ``_hash`` of the text, ``_from`` and ``_to``, ordinals of units with words).

    A run is made of neighbouring units that are not the earliest of their kind.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    schema = StructType(
        [
            source.schema["_id"],
            StructField("_hash", LongType()),
            StructField("_place", IntegerType()),
            StructField("_weight", IntegerType()),
            StructField("_digest", BinaryType()),
        ]
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, h, place, _weight(words), hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                for k, h, t in zip(batch["_id"], batch["_hash"], batch["_text"])
                for place, (_, _, words) in enumerate(passage_units(t))
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    units = materialise(source.mapInPandas(cut, schema), "passage-units")
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_place").alias("place"))
    # of a unit that stands once nothing more is needed
    first = units.groupBy("_digest").agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    # written, so that the join may split a unit that very many documents have
    first = materialise(first, "passage-firsts")
    again = units.join(first, "_digest").where(~rank.eqNullSafe(F.col("_first"))).select("_id", "_hash", "_place", "_weight").distinct()
    # the repeated units of one document; neighbours keep the same distance to their number
    number = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_place"))
    runs = again.withColumn("_run", F.col("_place") - number).groupBy("_id", "_hash", "_run").agg(
        F.min("_place").alias("_from"),
        F.max("_place").alias("_to"),
        F.sum(F.when(F.col("_weight") >= min_words, F.col("_weight")).otherwise(0)).alias("_words"),
    )
    return runs.where(F.col("_words") >= run_words).select("_id", "_hash", "_from", "_to")


def without_runs(text: str | None, runs: list[tuple[int, int]]) -> tuple[str | None, list[tuple[int, int]]]:
    """A text without some runs of its units, and their (start, length); ``runs`` ascend."""
    if not runs:
        return text, []
    bounds = [(start, end) for start, end, _ in passage_units(text)]
    spans = [(bounds[first][0], bounds[last][1]) for first, last in runs]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]]), [(start, end - start) for start, end in spans]


def passage_dedup(
    docs: DataFrame, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All documents: ``_row``, ``_id``, ``_text``, ``_cleaned`` and ``_removed`` (start, length; null where nothing goes)."""
    runs = materialise(repeated_runs(docs, min_words, run_words, id_col, text_col), "passage-runs")
    part = F.struct(F.col("_from").alias("first"), F.col("_to").alias("last"))
    gone = runs.groupBy(F.col("_id").alias("_cut"), F.col("_hash").alias("_cut_hash")).agg(F.sort_array(F.collect_list(part)).alias("_runs"))
    same = F.col("_id").eqNullSafe(F.col("_cut")) & (F.xxhash64("_text") == F.col("_cut_hash"))
    # runs grow with the documents: always a shuffled join
    joined = packed(docs, id_col, text_col).join(gone.hint("merge"), same, "left")
    span = StructType([StructField("start", LongType()), StructField("length", LongType())])
    kind = StructType([StructField("text", StringType()), StructField("spans", ArrayType(span))])

    @F.pandas_udf(kind)
    def clean(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        done = [without_runs(t, [(r["first"], r["last"]) for r in own]) for t, own in zip(texts, runs)]
        return pd.DataFrame({"text": [t for t, _ in done], "spans": [[{"start": a, "length": n} for a, n in spans] for _, spans in done]})

    # only what loses something goes through Python
    changed = F.when(F.col("_runs").isNotNull(), clean(F.when(F.col("_runs").isNotNull(), F.col("_text")), F.coalesce("_runs", F.array().cast("array<struct<first:int,last:int>>"))))
    cut = joined.withColumn("_done", changed)
    return cut.select(
        "_row", "_id", "_text", F.when(F.col("_runs").isNull(), F.col("_text")).otherwise(F.col("_done.text")).alias("_cleaned"),
        F.col("_done.spans").alias("_removed"),
    )


def drop_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All documents with their repeated passages removed."""
    done = passage_dedup(docs, min_words, run_words, id_col, text_col)
    return done.select(*[F.col("_cleaned").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
