"""Packing documents into token sequences: a cutting-stock problem solved by column generation.

Each document becomes its token ids and an end id. What fills whole sequences is cut off
its front; the rest, shorter than a sequence, has to share one. The lengths of the pieces
form a histogram of bounded size, whatever the number of documents. A linear program
over patterns (how many pieces of each length class fill a sequence) is solved on it, new
patterns being priced by a knapsack dynamic program. Patterns are used a rounded-down
number of times and what is left over is placed first-fit, still on the histogram. Spark
ranks the pieces of each length class and gives every rank its place in a pattern.

Defined results: a null or empty text has just the end id. Repeated rows are packed one
by one. A null id stays null. An empty table gives no pieces. Columns other than the id
and the text are not looked at.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from dayglass.llm.common import hand_back, kept_by_worker, small_batches
from dayglass.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_PER_SLICE = 20_000  # of one length class that are ranked in one sort, about
_CACHED_WORDS = 100_000  # memory of a worker; the ids do not depend on it
_CHARS_AT_ONCE = 1 << 17  # of texts that are encoded at a time, about; likewise
_LONG_WORD = 64

# Plain words are of printable ASCII and Latin letters of one code point. What the tokenizer
# does with them can be said in bytes: lower-case, then part runs of letters, single digits,
# runs of other characters, and contractions where no other character stands before them.
_GAPS, _PLAIN = " \t\n\r", "!-~À-ÖØ-öø-ÿ"
_ODD = re.compile(f"[^{_GAPS}{_PLAIN}]")
_GAP, _LETTER, _DIGIT, _OTHER = range(4)
_KINDS = np.full(256, _OTHER, dtype=np.uint8)
_KINDS[list(map(ord, _GAPS))] = _GAP
_KINDS[ord("a") : ord("z") + 1] = _KINDS[128:] = _LETTER
_KINDS[ord("0") : ord("9") + 1] = _DIGIT
_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}
_END = "</w>"
_MODEL = {"type": "BPE", "end_of_word_suffix": _END, "continuing_subword_prefix": None, "dropout": None}
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}


def _spelt(token: str) -> bytes:
    """A token of a byte-level vocabulary in bytes; the end of a word is a space, which no word holds."""
    ends = token.endswith(_END)
    return bytes(map(_BYTES.__getitem__, token[: -len(_END)] if ends else token)) + b" " * ends


@functools.cache
def merges_by_rank(path: str) -> bool:
    """Whether words of this tokenizer may be merged by the ids of what comes out.

    The tokenizer merges listed pairs, tiktoken any two neighbours that make up a token;
    both take the lowest first. Neighbours that cover a token's bytes came from merges
    inside them alone, so they are the last two parts of that token merged by itself. If
    these are the listed pair for every token, no others are ever merged.
    """
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    model = rules["model"]
    known = (
        all(rules.get(k) == v for k, v in _RULES.items())
        and all(model.get(k) == v for k, v in _MODEL.items())
        and not model.get("ignore_merges")
        and not any(t["normalized"] or re.search(r"\s", t["content"]) for t in rules["added_tokens"])
        and _BYTES.keys() >= set().union(*model["vocab"])
    )
    if not known:
        return False
    ranks = {_spelt(t): i for t, i in model["vocab"].items()}
    single = [r for token, r in ranks.items() if len(token.removesuffix(b" ") or token) == 1]
    if len(single) != 512 or len(ranks) != 512 + len(model["merges"]) or max(single) != 511:
        return False
    for rank, pair in enumerate(model["merges"], 512):
        left, right = map(_spelt, pair.split(" ") if isinstance(pair, str) else pair)
        whole = left + right
        if ranks.get(whole) != rank:
            return False
        parts = [whole[k : k + 1] for k in range(len(whole))]
        if parts[-1] == b" ":
            parts[-2:] = [whole[-2:]]
        while len(parts) > 2:
            first, k = min((ranks.get(x + y, rank), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
            if first == rank:
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if parts != [left, right]:
            return False
    return True


def _runs(text: bytes) -> tuple[str, np.ndarray]:
    """A lower-case plain text with a space after each of its runs, and where the runs begin in it."""
    data = np.frombuffer(text, dtype=np.uint8)
    kinds = _KINDS[data]
    first = np.ones(len(data), dtype=bool)
    first[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
    marks = np.flatnonzero(data == ord("'"))
    marks = marks[(marks == 0) | (kinds[marks - 1] != _OTHER)]
    if len(marks):
        ahead = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
        next_, third = ahead[marks + 1], ahead[marks + 2]
        one = marks[np.isin(next_, list(b"stmd"))]
        two = marks[(np.isin(next_, list(b"rv")) & (third == ord("e"))) | ((next_ == ord("l")) & (third == ord("l")))]
        first[one + 1] = first[two + 1] = False
        after = np.concatenate([one + 2, two + 3])
        first[after[after < len(data)]] = True
    first &= kinds != _GAP
    begins = np.flatnonzero(first)
    glued = begins[(begins > 0) & (kinds[begins - 1] != _GAP)]
    return np.insert(np.where(kinds == _GAP, np.uint8(32), data), glued, 32).tobytes().decode() + " ", begins


class WordTokens:
    """Token ids of texts as little-endian 32-bit numbers.

    The tokenizer drops white space and never merges across it. Plain words, which are most,
    are parted into runs all at once and merged by tiktoken with the tokenizer's vocabulary,
    if ``by_rank`` (see ``merges_by_rank``). Other words go through the tokenizer itself,
    and repeated ones are looked up; a zero byte holds their place meanwhile.
    """

    def __init__(self, path: str, by_rank: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}
        self._by_rank = by_rank
        if by_rank:
            self._load_ranks()
        hand_back()

    def _load_ranks(self) -> None:
        import tiktoken

        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        ranks = {_spelt(t): i for t, i in self._tokenizer.get_vocab(False).items() if t not in special}
        self._special = special
        either = "|".join(map(re.escape, special)) or "(?!)"
        self._odd_word = re.compile(
            f"(?<![^{_GAPS}])(?:(?!{either})[{_PLAIN}])*+(?:[^{_GAPS}{_PLAIN}]|{either})[^{_GAPS}]*"
        )
        self._ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self._ends[[i for token, i in ranks.items() if token.endswith(b" ")]] = True
        self._held = ranks[b"\0 "]
        # without a special token, tiktoken looks for an empty one at every character
        self._merger = tiktoken.Encoding(
            "runs", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={"\1": len(self._ends)}
        )

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text. Few texts are encoded at once, so that little is held beside them."""
        first, chars = 0, 0
        for i, text in enumerate(texts):
            chars += len(text or "")
            if chars >= _CHARS_AT_ONCE or i == len(texts) - 1:
                some = [t or "" for t in texts[first : i + 1]]
                if self._by_rank:
                    yield from self._some(some)
                else:
                    yield from (_bytes(e.ids) for e in self._tokenizer.encode_batch_fast(some, add_special_tokens=False))
                first, chars = i + 1, 0

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        odd: dict[int, list[str]] = {}
        plain = []
        for i, text in enumerate(texts):
            if _ODD.search(text) or any(s in text for s in self._special):
                odd[i] = self._odd_word.findall(text)
                text = self._odd_word.sub("\0", text)
            plain.append(text.lower().encode())
        self._learn(odd)
        spaced, begins = _runs(b"\n".join(plain))
        ids = self._merger.encode_to_numpy(spaced, disallowed_special=()).astype("<u4", copy=False)
        run_ends = np.concatenate([[0], np.flatnonzero(self._ends[ids]) + 1])
        if len(run_ends) != len(begins) + 1:
            raise RuntimeError(f"{len(begins)} runs of letters or signs came back as {len(run_ends) - 1}")
        text_ends = np.cumsum([len(t) + 1 for t in plain]) - 1
        parts = np.split(ids, run_ends[np.searchsorted(begins, text_ends)])
        for i, own in enumerate(parts[: len(texts)]):
            if i in odd:
                between = np.split(own, np.flatnonzero(own == self._held))
                yield between[0].tobytes() + b"".join(self._known[w] + b[1:].tobytes() for w, b in zip(odd[i], between[1:]))
            else:
                yield own.tobytes()
        if odd:
            self._forget(odd)

    def _learn(self, odd: dict[int, list[str]]) -> None:
        missing = [w for w in set().union(*odd.values()) if w not in self._known]
        encoded = self._tokenizer.encode_batch_fast(missing, add_special_tokens=False)
        self._known.update((w, _bytes(e.ids)) for w, e in zip(missing, encoded))

    def _forget(self, odd: dict[int, list[str]]) -> None:
        for word in set().union(*odd.values()):
            if len(word) > _LONG_WORD:
                del self._known[word]
        if len(self._known) > _CACHED_WORDS:
            self._known = {}
            hand_back()


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Rows (``_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``[, ``ids``]), cut every ``size`` ids."""
    small_batches(docs.sparkSession)
    numbers = [StructField(c, LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = StructType([source.schema["_id"], *numbers] + ([StructField("ids", BinaryType())] if with_ids else []))
    end = struct.pack("<I", end_id)
    by_rank = merges_by_rank(tokenizer_path)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = kept_by_worker().setdefault("word_tokens", {})
        tokens = kept.get(tokenizer_path) or kept.setdefault(tokenizer_path, WordTokens(tokenizer_path, by_rank))
        for batch in batches:
            rows = []
            for key, ids in zip(batch["_id"], tokens.batch(list(batch["_text"]))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, size):
                    own = ids[4 * start : 4 * (start + size)]
                    rows.append((key, start, len(own) // 4, zlib.crc32(own), total) + ((own,) if with_ids else ()))
            yield pd.DataFrame(rows, columns=schema.names)
        hand_back()

    return source.mapInPandas(cut, schema)


@dataclass(frozen=True)
class Plan:
    """Patterns (class -> pieces) with how often each is used."""

    patterns: list[tuple[dict[int, int], int]]

    @property
    def bins(self) -> int:
        return sum(n for _, n in self.patterns)


def _best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the room left; ``sizes`` ascend."""
    worth = np.full(capacity + 1, -1.0)
    worth[sizes] = value
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=int)
    for room in range(1, capacity + 1):
        gains = worth[1 : room + 1] + best[:room][::-1]
        k = gains.argmax()
        if gains[k] > best[room - 1] + 1e-12:
            best[room], choice[room] = gains[k], k + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        size = int(choice[room])
        if size:
            pattern[np.searchsorted(sizes, size)] += 1
        room -= size or 1
    return float(best[capacity]), pattern


def _first_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> Counter:
    """Patterns for a few left-over pieces, longest first into the first that has room."""
    rooms: list[int] = []
    held: list[Counter] = []
    for k in np.argsort(-sizes):
        for _ in range(int(counts[k])):
            at = next((i for i, room in enumerate(rooms) if room >= sizes[k]), None)
            if at is None:
                rooms.append(capacity)
                held.append(Counter())
                at = len(rooms) - 1
            rooms[at] -= int(sizes[k])
            held[at][int(sizes[k])] += 1
    return Counter(tuple(sorted(p.items())) for p in held)


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Matrix times vector without the linear-algebra library, whose threads may not survive a fork."""
    return np.einsum("ij,j->i", matrix, vector)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan elimination with row exchanges; no library threads either."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        best = k + int(np.abs(both[k:, k]).argmax())
        both[[k, best]] = both[[best, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0.0
        both -= factors[:, None] * both[k]
    return both[:, n:]


def solve(histogram: dict[int, int], capacity: int, gap: float = 5e-4, max_steps: int = 50_000) -> Plan:
    """Fewest sequences for the histogram of length classes, by column generation.

    The simplex basis holds one pattern for each class. Farley's bound ends the search
    when the optimum is within ``gap`` of what is found. More than ``max_steps`` exchanges
    of patterns are an error: a few for each class are usual.
    """
    sizes = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=int)
    if not len(sizes):
        return Plan([])
    demand = np.array([histogram[int(k)] for k in sizes], dtype=float)
    # a little more than the demand, unequal by class: no step stands still, so none repeats
    asked = demand + 1e-3 * (1 + np.random.default_rng(0).random(len(sizes)))
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    used = _times(inverse, asked)
    for step in range(1, max_steps + 1):
        prices = inverse.sum(axis=0)
        worth, pattern = _best_pattern(sizes, np.maximum(prices, 0.0), capacity)
        if worth <= 1 + gap:
            break
        change = _times(inverse, pattern)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = np.where(change > 1e-9, used / change, np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = pattern
        if step % 50 == 0:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / change[out]
            inverse -= np.outer(change, row)
            inverse[out] = row
        used = np.maximum(_times(inverse, asked), 0.0)
    else:
        raise RuntimeError(f"no packing plan within {max_steps} steps")
    times = np.floor(used + 1e-6).astype(int)
    # never more pieces than there are, whatever the rounding
    while np.any(_times(basis, times) > demand):
        over = int(np.argmax(_times(basis, times) - demand))
        times[int(np.argmax(np.where(times > 0, basis[over], 0)))] -= 1
    left = demand - _times(basis, times)
    patterns = [
        ({int(s): int(a) for s, a in zip(sizes, basis[:, j]) if a > 0}, int(n)) for j, n in enumerate(times) if n > 0
    ]
    patterns += [(dict(p), n) for p, n in sorted(_first_fit(sizes, left, capacity).items())]
    return Plan(patterns)


def _places(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per class: first ranks, pieces a sequence and first sequence of each pattern that has it."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    filled: Counter = Counter()
    first = 0
    for pattern, times in plan.patterns:
        for k, a in pattern.items():
            rows.setdefault(k, []).append((filled[k], a, first))
            filled[k] += a * times
        first += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for k, r in rows.items()}


def _planned(histogram: DataFrame, capacity: int) -> Plan:
    """Solve in a task: a worker's linear algebra keeps to one thread. At most ``capacity`` rows go in."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        plan = solve(dict(zip(rows["_class"].tolist(), rows["count"].tolist())), capacity)
        found = [(i, k, a, n) for i, (pattern, n) in enumerate(plan.patterns) for k, a in pattern.items()]
        return pd.DataFrame(found, columns=["pattern", "class", "pieces", "times"])

    solved = histogram.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "pattern int, class int, pieces int, times long")
    patterns: dict[int, tuple[dict[int, int], int]] = {}
    for r in solved.collect():
        patterns.setdefault(r["pattern"], ({}, r["times"]))[0][r["class"]] = r["pieces"]
    return Plan([patterns[i] for i in sorted(patterns)])


def _ranked(cut: DataFrame) -> DataFrame:
    """Number the pieces of each class from 0, the longest first within slices of a class.

    A class may hold any share of all pieces: it is dealt over slices by a hash, each is
    ranked on its own and starts where the earlier slices of its class end.
    """
    slices = 1 + cut.count() // ROWS_PER_SLICE
    dealt = cut.withColumn("_slice", F.pmod(F.xxhash64("_id", "start", "ids_crc32"), F.lit(slices)))
    before = Window.partitionBy("_class").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_class", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = totals.select("_class", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_class", "_slice").orderBy(F.desc("length"), "_id", "start", "ids_crc32")
    numbered = dealt.withColumn("_own", F.row_number().over(own) - 1)
    return numbered.join(offsets, ["_class", "_slice"]).withColumn("_rank", F.col("_own") + F.col("_before"))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = 2048,
    end_id: int = 1,
    step: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and gapless ``offset``.

    ``step`` is the width of a length class: a piece takes its length rounded up to it.
    ``with_ids`` keeps each piece's ids, so ``sequences`` can build the sequences.
    """
    capacity = size // step
    cut = pieces(docs, tokenizer_path, size, end_id, id_col, text_col, with_ids)
    cut = cut.withColumn("_class", F.ceil(F.col("length") / step).cast("int"))
    cut = materialise(cut, "packing-pieces")
    places = _places(_planned(cut.groupBy("_class").count(), capacity))

    @F.pandas_udf("long")
    def sequence(classes: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.empty(len(ranks), dtype=np.int64)
        kinds, wanted = classes.to_numpy(), ranks.to_numpy()
        for k in np.unique(kinds):
            firsts, a, starts = places[int(k)]
            at = np.flatnonzero(kinds == k)
            i = np.searchsorted(firsts, wanted[at], side="right") - 1
            out[at] = starts[i] + (wanted[at] - firsts[i]) // a[i]
        return pd.Series(out)

    placed = _ranked(cut).withColumn("sequence_id", sequence("_class", "_rank"))
    # at most ``size`` pieces share a sequence
    earlier = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("length"), "_id", "start", "ids_crc32", "_rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")
    return placed.select(
        F.col("_id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        offset.alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences of pieces packed ``with_ids``: ``ids`` (32-bit numbers), ``used``, ``padded``.

    Filled up to ``size``, but for sequences whose length is a power of two already.
    """
    joined = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"), F.sum("length").alias("used")
    )
    whole = F.aggregate("_parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    power = F.bit_count("used") == 1
    padded = F.when(power, F.col("used")).otherwise(F.greatest("used", F.lit(size)))
    fill = F.unhex(F.expr(f"repeat('{struct.pack('<I', pad_id).hex()}', cast(_padded - used as int))"))
    out = joined.withColumn("_padded", padded)
    return out.select("sequence_id", F.concat(whole, fill).alias("ids"), "used", F.col("_padded").alias("padded"))
