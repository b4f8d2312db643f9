"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are cut into a high and a low half. Two fingerprints that differ
in at most 2 bits either differ in at most one bit of the high half, or agree in the low
half. So a table of high halves is searched with a ball of radius 1 and a table of low
halves with a ball of radius 0, and every match is verified by its complete distance.
Halves that very many fingerprints share are searched by enumerating the complete ball
instead, which costs a fixed number of look-ups for each fingerprint however many share
the half. Both ways find the same links, so none is lost to a cap.

``near_duplicates`` is exact in this way. Similarities such as 0.8 lie far beyond two bits
of 64; ``drop_near_copies`` meets texts by their fingerprints' components and, for what
lies further apart, by bands of minimum hashes too, and decides by the exact similarity, as
said there.

Defined results: a null or wordless text has fingerprint zero and links like any other;
texts of fewer words than a shingle have one shingle. Repeated rows give a row each. A
null id never is a component's id unless all its ids are null. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.common import hand_back, packed, small_batches, unpacked, with_marks
from dayglass.llm.graph import components
from dayglass.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BLOCK = 1 << 15  # shingles that are counted bit by bit at a time

# Fingerprints sharing a half beyond which the complete ball is enumerated: about where
# both ways cost the same. Either way gives the same links.
CROWDED = 256


def shingles(text: str | None, width: int) -> list[bytes]:
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # of bytes: A-Z only
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*[words[i:] for i in range(width)])]


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit by bit the majority of the shingles' hashes, as a signed 64-bit number."""
    parts = shingles(text, width)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in parts), dtype=np.uint64, count=len(parts))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        octets = hashes[i : i + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``_id``, ``_hash`` of the text, ``_fp``), one for each document."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), of(F.col(text_col)).alias("_fp")
    )


HIGH, LOW = range(32, 64), range(32)


def _signed(bits: tuple[int, ...]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _flipped(flips: list[tuple[int, ...]]) -> Column:
    """The fingerprint with some bits flipped, for each entry whose first bit is set.

    Clearing the first bit makes every link found from one of its two sides only.
    """
    # one expression: a thousand columns made one by one take the driver longer than the search
    masks = F.expr(f"array({', '.join(f"named_struct('need', {_signed(f[:1])}L, 'flip', {_signed(f)}L)" for f in flips)})")
    usable = F.filter(masks, lambda m: F.col("_fp").bitwiseAND(m["need"]) != 0)
    return F.transform(usable, lambda m: F.col("_fp").bitwiseXOR(m["flip"]))


def _one(bits: range) -> list[tuple[int, ...]]:
    return [(b,) for b in bits]


def _two(bits: range) -> list[tuple[int, ...]]:
    return [(b, a) for b in bits for a in bits if a < b]


def _one_each(first: range, second: range) -> list[tuple[int, ...]]:
    return [(a, b) for a in first for b in second]


def _distance() -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")))


def _looked_up(some: DataFrame, distinct: DataFrame, flips: list[tuple[int, ...]]) -> DataFrame:
    """Look every flipped fingerprint up; each meets one entry at most."""
    probes = some.select(F.col("_fp").alias("a"), F.explode(_flipped(flips)).alias("b"))
    return probes.join(distinct.select(F.col("_fp").alias("b")), "b").select("a", "b")


def _within_half(table: DataFrame, reach: int) -> DataFrame:
    """Pairs that share a half, each from one side, verified by the complete distance."""
    met = table.select("_half", F.col("_fp").alias("a")).join(table.select("_half", F.col("_fp").alias("b")), "_half")
    return met.where((F.col("a") < F.col("b")) & (_distance() <= reach)).select("a", "b")


def links(distinct: DataFrame, reach: int = 2, crowded: int = CROWDED) -> DataFrame:
    """All pairs (``a``, ``b``) of distinct fingerprints ``_fp`` that differ in 1..``reach`` bits, 2 at most."""
    if reach not in (0, 1, 2):
        raise ValueError("two halves serve a reach of 0, 1 or 2")
    if reach == 0:
        return distinct.select(F.col("_fp").alias("a"), F.col("_fp").alias("b")).where(F.lit(False))
    high, low = F.shiftright("_fp", 32), F.col("_fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    ball = F.concat(F.array(high), F.transform(_flipped(_one(HIGH)), lambda f: F.shiftright(f, 32)))
    spread = distinct.select("_fp", high.alias("_own"), F.explode(ball).alias("_half"))
    spread = materialise(spread.select("_fp", "_half", (F.col("_own") == F.col("_half")).alias("_table")), "simhash-high")
    sizes = spread.groupBy("_half").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_table").alias("_entries"))
    busy = materialise(sizes.where((F.col("_n") > crowded) & (F.col("_entries") > 0)).select("_half"), "simhash-busy")
    calm, crowd = spread.join(busy, "_half", "left_anti"), spread.join(busy, "_half", "left_semi")
    entries = calm.where("_table").select("_half", F.col("_fp").alias("a"))
    probes = calm.where(~F.col("_table")).select("_half", F.col("_fp").alias("b"))
    near = entries.join(probes, "_half").where(_distance() <= reach).select("a", "b")
    found = [near, _within_half(calm.where("_table").select("_half", "_fp"), reach)]
    own, far = crowd.where("_table").select("_fp"), crowd.where(~F.col("_table")).select("_fp").distinct()
    both = reach == 2
    found.append(_looked_up(own, distinct, _one(LOW) + (_two(LOW) if both else [])))
    found.append(_looked_up(far, distinct, _one(HIGH) + (_one_each(HIGH, LOW) if both else [])))
    if both:
        lows = distinct.select("_fp", low.alias("_half"))
        packed_low = lows.groupBy("_half").count().where(F.col("count") > crowded).select("_half")
        packed_low = materialise(packed_low, "simhash-busy-low")
        found.append(_within_half(lows.join(packed_low, "_half", "left_anti"), reach))
        found.append(_looked_up(lows.join(packed_low, "_half", "left_semi").select("_fp"), distinct, _two(HIGH)))
    return reduce(DataFrame.unionByName, found)


def _rooted(least: DataFrame, reach: int) -> DataFrame:
    """A written table of distinct fingerprints ``_fp`` with ``_root``, the smallest of each one's component."""
    roots = components(links(least.select("_fp"), reach)).withColumnRenamed("node", "_fp")
    rooted = least.join(roots, "_fp", "left").select(*least.columns, F.coalesce("root", "_fp").alias("_root"))
    return materialise(rooted, "simhash-rooted")


def _components(docs: DataFrame, width: int, reach: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (``_id``, ``_hash``, ``_fp``, ``_root``, ``_least``): document, fingerprint, component."""
    prints = materialise(fingerprints(docs, width, id_col, text_col), "simhash-prints")
    least = materialise(prints.groupBy("_fp").agg(F.min("_id").alias("_min")), "simhash-distinct")
    rooted = _rooted(least, reach)
    smallest = rooted.groupBy("_root").agg(F.min("_min").alias("_least"))
    return prints.join(rooted.join(smallest, "_root").select("_fp", "_root", "_least"), "_fp")


def near_duplicates(
    docs: DataFrame, width: int = 3, reach: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable)."""
    return _components(docs, width, reach, id_col, text_col).select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_least").alias("component_id"),
    )


# --- similarity instead of a few bits ----------------------------------------------------
#
# Texts whose fingerprints hang together meet by their component, whatever else they share.
# Texts of a Jaccard similarity of 0.8 differ in far more than two bits. They are met by
# minimum hashes besides: a band is the minima of a shingle set under ``BAND_ROWS`` hash
# functions, and two texts of similarity s share one with chance s ** BAND_ROWS. A pair of
# exactly 0.8 shares none of ``BANDS`` bands with chance 4e-13. What meets either way is a
# candidate only: links are decided by the exact similarity of the shingle sets.

BANDS, BAND_ROWS = 72, 5
BLOCK = 64  # members of a band value up to which they are compared with each other
FACED = 1_024  # members of a rare shingle that face as many others in one task
MOST_CELLS = 1 << 21  # of the table of shingle counts that is broadcast
_CHUNK = 2048  # shingles that meet all hash functions at a time
_ODD = np.random.default_rng(42).integers(0, 1 << 31, (2, BANDS * BAND_ROWS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    parts, digest = shingles(text, width), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in parts), dtype=np.uint64, count=len(parts)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One number for each band of a set of hashes; none for the empty set."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(hashes), _CHUNK):
        mixed = low[i : i + _CHUNK] * _ODD[0][:, None]
        mixed += high[i : i + _CHUNK] * _ODD[1][:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + row
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def prefix_length(size: int, similarity: float) -> int:
    """Of two sets that similar, in any common order of elements, the first so many hold one they share."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def _rare_first(sets: DataFrame, similarity: float) -> DataFrame:
    """Rows (``_at``, ``_node``, ``_pos``, ``_size``): the rarest shingles of each set, enough to meet every set that similar.

    Rarity is read from a table of counts with a bounded number of cells that shingles
    are hashed to. Any order that all sets share meets all pairs, so what the counts leave
    open, or get wrong, costs time and no pair. Texts that merely have a common passage
    meet nobody by it: their own words are rarer.
    """
    total = sets.agg(F.sum(F.size("_set"))).first()[0] or 1
    cells = min(MOST_CELLS, 1 << max(10, int(total).bit_length()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for own in batch["_set"]:
                np.add.at(counts, np.asarray(own, dtype=np.int64) & (cells - 1), 1)
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"cell": used, "n": counts[used]})

    # at most ``cells`` rows
    found = sets.mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(cells, dtype=np.uint32)
    often[found["cell"].to_numpy(dtype=np.int64)] = np.minimum(found["n"].to_numpy(dtype=np.int64), (1 << 32) - 1)
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        for batch in batches:
            rows = [np.empty((4, 0), dtype=np.int64)]
            for node, own in zip(batch["_node"], batch["_set"]):
                own = np.asarray(own, dtype=np.int64)
                first = np.lexsort((own, counts[own & (cells - 1)]))[: prefix_length(len(own), similarity)]
                same = np.full(len(first), node, dtype=np.int64), np.full(len(first), len(own), dtype=np.int64)
                rows.append(np.stack([own[first], same[0], np.arange(len(first)), same[1]]))
            yield pd.DataFrame(dict(zip(("_at", "_node", "_pos", "_size"), np.concatenate(rows, axis=1))))

    return sets.mapInPandas(pick, "_at long, _node long, _pos long, _size long")


def _sized(rows: DataFrame, label: str) -> DataFrame:
    """Rows of values that several nodes have, written, with ``_n``, the number of the value's nodes."""
    sizes = rows.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return materialise(rows.join(sizes, "_at"), label)


def similar_links(
    keyed: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    similarity: float,
    block: int = BLOCK,
    faced: int = FACED,
) -> DataFrame:
    """Links (``a``, ``b``) that hang together what is of at least that exact similarity and shares a value.

    ``keyed`` has rows (``_node``, ``_keys``), bands or other values that nodes meet by, none
    of them twice for a node; ``sets_of`` gives (``_node``, ``_set``) for a table of nodes. Every member of a value is compared with the member that shares
    most with all others first, and then with those it does not hang together with yet.
    Up to ``block`` members of a value do so pair by pair. Nodes of a crowded value
    meet each other anew, by their rarest shingles instead of their values, which loses no
    pair of that similarity, and of the pairs that meet there only those are compared
    whose places in their sets leave room for it.
    """
    met = _sized(keyed.select("_node", F.explode("_keys").alias("_at")), "similar-meetings")
    sets = materialise(sets_of(met.select("_node").distinct()).select("_node", "_set"), "similar-sets")

    def alike(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("_node").alias("a"), F.col("_set").alias("_a"))
        right = sets.select(F.col("_node").alias("b"), F.col("_set").alias("_b"))
        both, shared = F.size("_a") + F.size("_b"), F.size(F.array_intersect("_a", "_b"))
        near = (F.least(F.size("_a"), F.size("_b")) / F.greatest(F.size("_a"), F.size("_b")) >= similarity)
        met = pairs.distinct().join(left, "a").join(right, "b").where(near)
        return met.where(shared / (both - shared) >= similarity).select("a", "b")

    busy = materialise(met.where(F.col("_n") > block).select("_node").distinct(), "similar-busy")
    marked = busy.select(F.col("_node").alias("_known"))
    light = met.where(F.col("_n") <= block).join(marked, F.col("_node") == F.col("_known"), "left")
    light = light.select("_at", "_node", "_n", F.col("_known").isNotNull().alias("_busy"))
    stars, rest = _star_links(light, alike)
    left = rest.select("_at", F.col("_node").alias("a"), F.col("_root").alias("_a"), F.col("_busy").alias("_ab"))
    right = rest.select("_at", F.col("_node").alias("b"), F.col("_root").alias("_b"), F.col("_busy").alias("_bb"))
    wanted = (F.col("a") < F.col("b")) & (F.col("_a") != F.col("_b")) & ~(F.col("_ab") & F.col("_bb"))
    links = stars.unionByName(alike(left.join(right, "_at").where(wanted).select("a", "b")))

    crowd = _sized(_rare_first(sets.join(busy, "_node", "left_semi"), similarity), "similar-rare")
    stars, rest = _star_links(crowd.withColumn("_busy", F.lit(False)), alike)
    return links.unionByName(stars).unionByName(alike(_faced_pairs(rest, similarity, faced)))


def _star_links(met: DataFrame, alike: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Links of each value's most popular member, and the rows of values that still fall apart, with ``_root``.

    Two ``_busy`` nodes are left to others.
    """
    # a copy that others were made from shares more of its values, with more of them, than they do
    popular = met.groupBy("_node").agg(F.sum("_n").alias("_popular"))
    ranked = met.join(popular, "_node").select("_at", "_node", "_busy", "_popular")
    hub = F.max_by(F.struct(F.col("_node").alias("node"), F.col("_busy").alias("busy")), F.struct("_popular", "_node"))
    hubs = materialise(ranked.groupBy("_at").agg(hub.alias("_hub")), "similar-hubs")
    others = met.join(hubs, "_at").where((F.col("_node") != F.col("_hub.node")) & ~(F.col("_busy") & F.col("_hub.busy")))
    ends = F.least("_hub.node", "_node").alias("a"), F.greatest("_hub.node", "_node").alias("b")
    stars = materialise(alike(others.select(*ends)), "similar-stars")
    roots = components(stars).withColumnRenamed("node", "_node")
    rooted = met.join(roots, "_node", "left").withColumn("_root", F.coalesce("root", "_node")).drop("root")
    rooted = materialise(rooted, "similar-rooted")
    apart = rooted.groupBy("_at").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high"), F.min("_busy").alias("_all_busy"))
    apart = apart.where((F.col("_low") < F.col("_high")) & ~F.col("_all_busy")).select("_at")
    return stars, rooted.join(materialise(apart, "similar-apart"), "_at")


def _room(pos: np.ndarray, size: np.ndarray, other_pos: np.ndarray, other_size: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets that share an element at these places, and none before, can be that similar."""
    needed = np.ceil(similarity / (1 + similarity) * (size[:, None] + other_size[None, :]) - 1e-9)
    left = np.minimum((size - pos)[:, None], (other_size - other_pos)[None, :])
    return left >= needed


def _faced_pairs(rest: DataFrame, similarity: float, faced: int) -> DataFrame:
    """Pairs that share a rare shingle, hang together with different others, and have room for the similarity.

    Members of a value face each other in blocks of about ``faced`` rows, so no task holds
    more than two. Blocks of one large component each need not face their own.
    """
    large = rest.groupBy("_at", "_root").agg(F.count(F.lit(1)).alias("_members"))
    part = F.pmod(F.xxhash64("_node"), F.ceil(F.col("_members") / faced))
    mixed = F.pmod(F.xxhash64("_root"), F.ceil(F.col("_n") / faced))
    owner = F.when(F.col("_members") > faced, F.col("_root"))
    rows = rest.join(materialise(large, "similar-members"), ["_at", "_root"]).select(
        "_at", "_node", "_root", "_pos", "_size", owner.alias("_owner"), F.when(owner.isNull(), mixed).otherwise(part).alias("_part")
    )
    rows = rows.withColumn("_block", F.xxhash64(F.coalesce("_owner", F.lit(0)), F.col("_owner").isNull(), "_part"))
    rows = materialise(rows, "similar-crowd")
    blocks = rows.select("_at", "_block", "_owner").distinct()
    ones = blocks.select("_at", F.col("_block").alias("_i"), F.col("_owner").alias("_io"))
    others = blocks.select("_at", F.col("_block").alias("_j"), F.col("_owner").alias("_jo"))
    known = F.coalesce(F.col("_io") == F.col("_jo"), F.lit(False))
    against = ones.join(others, "_at").where((F.col("_i") <= F.col("_j")) & ~known)
    against = against.select("_at", "_i", "_j", F.explode(F.array_distinct(F.array("_i", "_j"))).alias("_block"))
    met = rows.drop("_owner", "_part").join(against, ["_at", "_block"])

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        node, root, pos, size = (group[c].to_numpy() for c in ("_node", "_root", "_pos", "_size"))
        found = [np.empty((2, 0), dtype=np.int64)]
        for first in range(0, len(node), 128):
            own = slice(first, first + 128)
            open_ = _room(pos[own], size[own], pos, size, similarity)
            open_ &= (root[own, None] != root[None, :]) & (node[own, None] < node[None, :])
            a, b = np.nonzero(open_)
            found.append(np.stack([node[own][a], node[b]]))
        return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["a", "b"])

    return met.groupBy("_at", "_i", "_j").applyInPandas(pairs, "a long, b long")


def _similar_components(
    docs: DataFrame, width: int, similarity: float, reach: int, print_width: int, id_col: str, text_col: str
) -> DataFrame:
    """Rows (``_id``, ``_hash``, ``_root``) by similarity; texts of equal shingle sets are one node."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("_node long, _keys array<long>, _fp long")
    def banded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t, width) for t in texts]
            nodes = [np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64) for s in sets]
            prints = np.array([fingerprint(t, print_width) for t in texts], dtype=np.int64)
            yield pd.DataFrame({"_node": nodes, "_keys": [band_keys(s) for s in sets], "_fp": prints})
        hand_back()

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, width).view(np.int64) for t in texts], dtype=object)
        hand_back()

    texts = docs.select(F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    prints = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), banded(F.col(text_col)).alias("_of"))
    prints = materialise(prints.select("_id", "_hash", "_of.*"), "similar-prints")
    least = prints.groupBy("_node").agg(F.min("_hash").alias("_hash"), F.first("_keys").alias("_keys"))
    distinct = materialise(least, "similar-distinct")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = distinct.join(nodes, "_node").select("_node", "_hash")
        # wanted texts grow with the documents: always a shuffled join
        held = texts.join(wanted.hint("merge"), "_hash").dropDuplicates(["_node"])
        return held.select("_node", of(F.col("_text")).alias("_set"))

    # a node may have several fingerprints: they count repeats, its set does not
    owned = materialise(prints.select("_fp", "_node").distinct(), "simhash-nodes")
    rooted = _rooted(owned.select("_fp").distinct(), reach)
    hung = owned.join(rooted, "_fp").select("_node", F.xxhash64(F.lit("simhash"), "_root").alias("_key")).distinct()
    keyed = distinct.select("_node", "_keys").unionByName(hung.select("_node", F.array("_key").alias("_keys")))
    links = similar_links(keyed, sets_of, similarity)
    roots = components(links).withColumnRenamed("node", "_node")
    return prints.select("_id", "_hash", "_node").join(roots, "_node", "left").select(
        "_id", "_hash", F.coalesce("root", "_node").alias("_root")
    )


def drop_near_copies(
    docs: DataFrame,
    width: int = 5,
    similarity: float | None = 0.8,
    reach: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    print_width: int = 3,
) -> DataFrame:
    """One document of each component, all its columns: the smallest id, then the smallest text hash.

    Components link texts of at least that exact Jaccard similarity on ``width``-word
    shingles, met by fingerprints of ``print_width``-word shingles ``reach`` bits apart and by
    bands. Where ``similarity`` is None they link fingerprints of ``width``-word shingles.
    """
    if similarity is None:
        found = _components(docs, width, reach, id_col, text_col).select("_id", "_hash", "_root")
    else:
        found = _similar_components(docs, width, similarity, reach, print_width, id_col, text_col)
    members = materialise(found, "simhash-members")
    rank = F.struct(F.col("_id").isNull(), "_id", "_hash")
    chosen = members.groupBy("_root").agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    chosen = chosen.where(F.col("_rows") > 1).drop("_rows")
    sized = members.groupBy("_root", "_id", "_hash").agg(F.count(F.lit(1)).alias("_rows")).join(chosen, "_root")
    verdict = sized.select(
        F.col("_id").alias("_verdict_id"),
        F.col("_hash").alias("_verdict_hash"),
        rank.eqNullSafe(F.col("_first")).alias("_kept"),
        "_rows",
    )
    verdict = materialise(verdict, "simhash-verdicts")
    rows = packed(docs, id_col, text_col).withColumn("_hash", F.xxhash64("_text"))
    # what is in no component of several rows passes as it is read
    found = with_marks(rows, F.xxhash64("_id", "_hash"), verdict.select(F.xxhash64("_verdict_id", "_verdict_hash").alias("_key")))
    same = F.col("_id").eqNullSafe(F.col("_verdict_id")) & (F.col("_hash") == F.col("_verdict_hash"))
    # verdicts grow with the documents: always a shuffled join
    joined = found.where("_marked").join(verdict.hint("merge"), same, "left")
    once = joined.where(F.col("_kept").isNull() | (F.col("_kept") & (F.col("_rows") == 1)))
    repeated = joined.where(F.col("_kept") & (F.col("_rows") > 1)).dropDuplicates(["_id", "_hash"])
    return unpacked(found.where("not _marked")).unionByName(unpacked(once)).unionByName(unpacked(repeated))
