"""Benchmark decontamination: windows of test words looked up in all windows of the documents.

Only columns of the DataFrame API; no Python runs on the executors.

Defined results: a null or wordless text has no words and no hits, and a wordless test
item has no window. An item shorter than a window is one window of all its words.
Repeated documents give a row each; repeated items count once. Empty tables are allowed
on either side. Columns other than the named ones pass through ``remove_documents`` and
``remove_spans`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass.llm.common import BROADCAST_ROWS, ascii_lower, broadcast_if_small, packed, unpacked, with_marks
from dayglass.session import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = BROADCAST_ROWS  # two numbers each
# the same letters before lower-casing
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text; none where it is null."""
    lowered = ascii_lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _hashes(words_: Column) -> Column:
    """One hash for each word, made once; windows are hashed from these."""
    return F.transform(words_, lambda w: F.xxhash64(w))


_WINDOW = ["_length", "_hash", "_gram"]


def _windows(length: int) -> Column:
    """Length and hash of all runs of ``length`` words of ``_h``, with their place."""
    last = F.size("_h") - length

    def one(i: Column) -> Column:
        return F.struct(i.alias("_at"), F.lit(length).alias("_length"), F.xxhash64(F.slice("_h", i + 1, length)).alias("_hash"))

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(
        F.filter(F.array(one(F.lit(0))), lambda _: F.lit(False))
    )


def test_windows(items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct rows (``_length``, ``_hash``, ``_gram``, ``_item``): each item's windows, words included."""
    split = items.select(F.col(id_col).alias("_item"), words(F.col(text_col)).alias("_words"))
    sized = split.where(F.size("_words") > 0).withColumn("_length", F.least(F.size("_words"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("_words") - F.col("_length") + 1)
    runs = sized.select("_item", "_length", F.explode(F.transform(starts, lambda i: F.slice("_words", i, F.col("_length")))).alias("_gram"))
    return runs.select("_length", F.xxhash64(_hashes(F.col("_gram"))).alias("_hash"), "_gram", "_item").distinct()


def _hits(docs: DataFrame, tests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row of length 0 for each document, and one for each place of a test window in it.

    One pass over the documents looks all windows up: the row of length 0 travels with
    the windows and meets an entry of its own in the hash set, so documents without a hit
    keep their row. A window travels as its place, length and hash; no text does. The set
    is broadcast behind a count of its rows, which are two numbers each, and shuffled
    beyond. What was hit is then verified.
    """
    entry = tests.sparkSession.range(1).select(F.lit(0).alias("_length"), F.lit(0).cast("long").alias("_hash"))
    known = materialise(tests.select("_length", "_hash").distinct().unionByName(entry), "test-window-set")
    # at most ``width`` different lengths
    lengths = sorted(r[0] for r in known.where("_length > 0").select("_length").distinct().collect())
    mark = F.array(F.struct(F.lit(0).alias("_at"), F.lit(0).alias("_length"), F.lit(0).cast("long").alias("_hash")))
    # through a generator: what reads the hashes never sees, and reruns, what made them
    made = F.inline(F.array(F.struct(_hashes(words(F.col(text_col))).alias("_h"))))
    split = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), made)
    opened = split.select(
        "_id", "_text", F.size("_h").cast("long").alias("_n"), F.inline(F.concat(mark, *[_windows(n) for n in lengths]))
    )
    met = opened.join(broadcast_if_small(known, BROADCAST_WINDOWS), ["_length", "_hash"])
    met = materialise(met.select("_id", "_text", "_n", "_at", "_length", "_hash"), "test-meetings")
    whole = met.where("_length = 0").select("_id", "_text", "_n", "_at", "_length", "_hash", F.lit(None).cast("array<string>").alias("_gram"))
    return materialise(whole.unionByName(_verified(docs, met.where("_length > 0"), tests, id_col, text_col)), "test-hits")


def _verified(docs: DataFrame, found: DataFrame, tests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those places at which a document has the very words of a test window, with these.

    Documents without a meeting are told apart as they are read; only the others' texts
    are shuffled, each once, to meet its places.
    """
    place = F.struct("_at", "_length", "_hash")
    # the places of one document
    places = materialise(
        found.distinct().groupBy(F.col("_id").alias("_met"), F.col("_text").alias("_met_text")).agg(
            F.max("_n").alias("_n"), F.collect_list(place).alias("_places")
        ),
        "test-places",
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.col(text_col).alias("_said"))
    marked = with_marks(rows, F.xxhash64("_id", "_text"), places.select(F.xxhash64("_met", "_met_text").alias("_key")))
    same = F.col("_id").eqNullSafe(F.col("_met")) & (F.col("_text") == F.col("_met_text"))
    joined = marked.where("_marked").join(places.hint("merge"), same)
    # rows that repeat id and text have the same places, and each of them is wanted
    split = joined.select("_id", "_text", "_n", "_places", F.inline(F.array(F.struct(words(F.col("_said")).alias("_words")))))
    own = F.transform(
        "_places", lambda p: F.struct(p["_at"].alias("_at"), p["_length"].alias("_length"), p["_hash"].alias("_hash"),
                                      F.slice("_words", p["_at"] + 1, p["_length"]).alias("_gram"))
    )
    told = split.select("_id", "_text", "_n", F.inline(own))
    return told.join(tests.select(*_WINDOW).distinct(), _WINDOW, "left_semi")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per document: id, ``text_hash``, ``n_words``, merged word ``spans`` of hits, ``n_hit``, ``items`` as sorted text."""
    tests = materialise(test_windows(items, width, item_col, item_text), "test-windows")
    hits = _hits(docs, tests, id_col, text_col)
    key = ["_id", "_text"]
    found = hits.where("_length > 0")
    # overlapping windows of one document become spans; a partition is one document's hits
    places = found.groupBy(*key, "_at").agg(F.max("_length").alias("_length"))
    before = Window.partitionBy(*key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_at") + F.col("_length")
    opens = places.withColumn("_reach", F.max(end).over(before)).withColumn(
        "_opens", F.coalesce(F.col("_at") > F.col("_reach"), F.lit(True)).cast("int")
    )
    islands = opens.withColumn("_span", F.sum("_opens").over(upto))
    spans = islands.groupBy(*key, "_span").agg(F.min("_at").alias("start"), F.max(end).alias("end"))
    covered = spans.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"),
    )
    # the items of a window are a table, joined to the windows that were found
    pairs = found.select(*key, *_WINDOW).distinct().join(tests.select(*_WINDOW, "_item"), _WINDOW).select(*key, "_item").distinct()
    named = pairs.groupBy(*key).agg(F.sort_array(F.collect_list(F.col("_item").cast("string"))).alias("items"))
    both = covered.join(named, [covered[c].eqNullSafe(named[c]) for c in key]).select(
        *[covered[c].alias(f"{c}_hit") for c in key], "spans", "n_hit", "items"
    )
    base = hits.where("_length = 0").select(*key, "_n")
    joined = base.join(both, [F.col(c).eqNullSafe(F.col(f"{c}_hit")) for c in key], "left")
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_text").alias("text_hash"),
        F.col("_n").alias("n_words"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def remove_documents(
    docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", **names: str
) -> DataFrame:
    """Documents without any hit, all their columns."""
    hit = _hit_documents(docs, items, width, id_col, text_col, names)
    rows = packed(docs, id_col, text_col).withColumn("_hash", F.xxhash64("_text"))
    # what has no hit passes as it is read
    found = with_marks(rows, F.xxhash64("_id", "_hash"), hit.select(F.xxhash64("_hit_id", "_hit_text").alias("_key")))
    same = F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_hash") == F.col("_hit_text"))
    clean = found.where("_marked").join(hit.hint("merge"), same, "left_anti")
    return unpacked(found.where("not _marked")).unionByName(unpacked(clean))


def remove_spans(
    docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", **names: str
) -> DataFrame:
    """All documents, their hit words cut out together with what follows each of them."""
    joined = _with_spans(docs, items, width, id_col, text_col, names, "left")
    # only what has a hit is taken apart, and once: the parts pass through a generator
    apart = F.struct(
        F.when(F.col("_spans").isNotNull(), F.regexp_extract_all("_text", F.lit(_ANY_CASE), F.lit(0))).alias("_word"),
        F.when(F.col("_spans").isNotNull(), F.split("_text", _ANY_CASE, -1)).alias("_gap"),
    )
    parts = joined.select("_row", "_text", "_spans", F.inline(F.array(apart)))
    # the spans ascend and do not touch, so the one that may hold a word is the last to begin at or before it
    begun = F.transform("_spans", lambda s: s["start"])

    def part(w: Column, i: Column) -> Column:
        place = F.size(F.filter(F.col("_begun"), lambda b: b <= i))
        cut = (place > 0) & (i < F.get(F.col("_spans"), place - 1)["end"])
        return F.when(cut, F.lit("")).otherwise(F.concat(w, F.element_at("_gap", i + 2)))

    begun_once = parts.select("*", F.inline(F.array(F.struct(begun.alias("_begun")))))
    rest = F.concat(F.element_at("_gap", 1), F.array_join(F.transform("_word", part), ""))
    cleaned = F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(rest)
    return begun_once.select(*[cleaned.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def _hit_documents(docs: DataFrame, items: DataFrame, width: int, id_col: str, text_col: str, names: dict[str, str]) -> DataFrame:
    """Written table of the documents with a hit: (``_hit_id``, ``_hit_text``, ``_spans``)."""
    found = contamination(docs, items, width, id_col, text_col, **names).where("n_hit > 0")
    hit = found.select(
        F.col(id_col).alias("_hit_id"), F.col("text_hash").alias("_hit_text"), F.col("spans").alias("_spans")
    ).distinct()
    return materialise(hit, "test-hit-documents")


def _with_spans(
    docs: DataFrame, items: DataFrame, width: int, id_col: str, text_col: str, names: dict[str, str], how: str
) -> DataFrame:
    hit = _hit_documents(docs, items, width, id_col, text_col, names)
    same = F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("_text") == F.col("_hit_text"))
    # hits grow with the documents: always a shuffled join
    return packed(docs, id_col, text_col).join(hit.hint("merge"), same, how)
