"""Token counts of a unigram tokenizer without building the tokens.

An Aho-Corasick automaton over the vocabulary finds every piece that ends at each place
of a word. Dynamic programming carries the best score and the number of pieces that it
takes. Ties go as in the public tokenizers library: of equal scores the longest last
piece stays. A character that no piece of one character covers may be unknown, at ten
below the lowest score; unknown characters in a row are one piece, or their bytes where
the vocabulary has all byte pieces.

Words start at each space, which belongs to the word after it, and a text starts with
one. Defined results: a null or empty text has no tokens. Repeated rows count alike; an
empty table gives no rows. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.llm.common import kept_by_worker, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
_CACHED_WORDS = 150_000  # memory of a worker; counts do not depend on it
_UNKNOWN_PENALTY = 10.0


def piece_scores(path: str) -> list[tuple[str, float]]:
    """Pieces of a vocabulary file; the r-th gets the score -log(r), as by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), -math.log(i + 1)) for i in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self._found = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self._found.add_word(piece, (len(piece), score))
        self._found.make_automaton()
        self._single = {p for p, _ in vocabulary if len(p) == 1}
        self._unknown = min(s for _, s in vocabulary) - _UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        self._bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self._known: dict[str, int] = {}

    def _count(self, word: str) -> int:
        if not self._single.issuperset(word):
            return self._count_with_unknown(word)
        size = len(word)
        best, pieces = [0.0] + [-math.inf] * size, [0] * (size + 1)
        # places ascend, and at each the longest match comes first
        for last, (length, own) in self._found.iter(word):
            end = last + 1
            score = best[end - length] + own
            if score > best[end]:
                best[end], pieces[end] = score, pieces[end - length] + 1
        return pieces[size]

    def _count_with_unknown(self, word: str) -> int:
        size = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for last, (length, score) in self._found.iter(word):
            ending[last + 1].append((length, score))
        # best score, pieces before the open run of unknown characters, that run's pieces
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for end in range(1, size + 1):
            score, whole, run = -math.inf, 0, 0
            for length, own in sorted(ending[end], reverse=True):
                before = best[end - length]
                if before[0] + own > score:
                    score, whole, run = before[0] + own, before[1] + before[2] + 1, 0
            char = word[end - 1]
            if char not in self._single:
                before = best[end - 1]
                if before[0] + self._unknown > score:
                    score, whole = before[0] + self._unknown, before[1]
                    run = before[2] + len(char.encode("utf-8", "surrogatepass")) if self._bytes else 1
            best.append((score, whole, run))
        return best[size][1] + best[size][2]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        spaced = text.replace(" ", SPACE)
        words = (spaced[1:] if spaced[0] == SPACE else spaced).split(SPACE)
        total = 0
        for word in words:
            found = self._known.get(word)
            if found is None:
                found = self._count(SPACE + word)
                if len(word) <= 64:
                    self._known[word] = found
            total += found
        if len(self._known) > _CACHED_WORDS:
            self._known = {}
        return total


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_tokens``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept = kept_by_worker().setdefault("unigram_counters", {})
        counter = kept.get(vocabulary_path)
        if counter is None:
            counter = kept[vocabulary_path] = UnigramCounter(piece_scores(vocabulary_path))
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return docs.select(F.col(id_col), counted(F.col(text_col)).alias("n_tokens"))
