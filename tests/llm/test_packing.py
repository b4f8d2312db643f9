from __future__ import annotations

import json
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dayglass.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def token_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


ODD = [
    "It's  a\ttest\x1cx   y’s 12ab 3.4 <|endoftext|>x A<|startoftext|>B ΑΣ é ́a ﬁ ½ İ",
    "", " ", "\n\n", "a" * 5000, "don't DON'T 're x're '", "\x00\x01 \x7f~", "🙂🙃 한국어 日本語", "a_b-c__d ÀÉß ÿ×÷",
]


def test_word_tokens_are_the_tokenizer_s(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD
    tokenizer = Tokenizer.from_file(PATH)
    for text, got in zip(texts, packing.WordTokens(PATH).batch(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece(seed):
    rng = random.Random(seed)
    lengths = [min(256, 1 + int(rng.expovariate(1 / rng.choice([5, 60, 200])))) for _ in range(10 ** (1 + seed))]
    histogram = Counter(lengths)
    plan = packing.solve(dict(histogram), 256)
    placed = Counter()
    for pattern, times in plan.patterns:
        assert sum(k * n for k, n in pattern.items()) <= 256
        placed.update({k: n * times for k, n in pattern.items()})
    assert placed == histogram
    if len(lengths) >= 1000:  # long histograms pack within one percent of the room they need
        assert plan.bins <= 1.01 * -(-sum(lengths) // 256) + sum(n for k, n in histogram.items() if k > 128) * 0.02 + 2
    assert packing.solve({}, 256).bins == 0


def test_pieces_cover_documents(spark, awkward, nothing):
    rows = packing.pack(awkward, PATH, size=256, with_ids=True).collect()
    texts = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sum(r.length for r in rows) == sum(len(token_ids(t)) for _, t in texts)
    for key, text in dict(texts).items():
        ids, at = token_ids(text), 0
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.start)
        copies = sum(k == key for k, _ in texts)
        for r in own[::copies]:
            assert r.start == at and r.doc_tokens == len(ids)
            cut = np.array(ids[at : at + r.length], dtype="<u4").tobytes()
            assert zlib.crc32(cut) == r.ids_crc32 and cut == bytes(r.ids)
            at += r.length
        assert at == len(ids)
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 256 and sorted(by) == list(range(len(by)))
    assert packing.pack(nothing, PATH).count() == 0


def test_sequences_are_padded(spark, awkward):
    done = packing.sequences(packing.pack(awkward, PATH, size=256, with_ids=True), 256).collect()
    for r in done:
        assert len(r["ids"]) == 4 * r.padded and r.padded >= r.used
        assert r.padded == (r.used if r.used & (r.used - 1) == 0 else 256)


def test_few_words_are_held_at_once():
    """A batch of long texts is split bit by bit: words that go must not lie all over a worker's memory."""
    import tracemalloc

    tokens = packing.WordTokens(PATH)
    texts = [None, *[" ".join(f"word{i % 50}" for i in range(2_000))] * 200, ""]
    tracemalloc.start()
    total = sum(len(ids) for ids in tokens.batch(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 200 * len(next(tokens.batch(texts[1:2])))
    assert peak < 8_000_000


def test_new_words_cost_little_more_than_known_ones():
    """Made-up prose goes on bringing new words, more than a worker can keep."""
    rng = random.Random(1)
    new = " ".join("".join(rng.choices("etaoinshr", k=9)) + "," for _ in range(100_000))
    known = " ".join(rng.choices(new.split(" ")[:50], k=100_000))
    tokens = packing.WordTokens(PATH)
    seconds = []
    for text in (known, new):
        begun = time.process_time()
        got = next(tokens.batch([text]))
        seconds.append(time.process_time() - begun)
        assert np.frombuffer(got, "<u4").tolist() == token_ids(text)[:-1]
    assert seconds[1] < 5 * seconds[0]
    assert not tokens._known  # plain words fill no look-up table


def test_word_tokens_of_random_signs():
    rng = random.Random(2)
    plain = [*"strevmldaBÉ342'''-!\"<| \n\t", "'s", "'T", "'RE", "'ll", "the", "tion"]
    odd = [*"\r\x0b\x1c\xa0\x85 ’é́ΩΣά日🙂½²µª×İıŉǆ\0\1", "<|endoftext|>", "é", "\0 "]
    texts = ["".join(rng.choices(plain + odd, k=rng.randint(0, 40))) for _ in range(3_000)]
    texts += ["".join(rng.choices(plain, k=rng.randint(0, 60))) for _ in range(3_000)]
    expected = Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)
    got = list(packing.WordTokens(PATH).batch(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in expected]


def test_only_proven_vocabularies_are_merged_by_rank(tmp_path):
    assert packing.merges_by_rank(PATH)
    with open(PATH, encoding="utf-8") as file:
        rules = json.load(file)
    rules["model"]["merges"][6] = ["t", "he</w>"]  # never met, as "th" is merged before
    made = str(tmp_path / "made.json")
    with open(made, "w", encoding="utf-8") as file:
        json.dump(rules, file)
    assert not packing.merges_by_rank(made)
    texts = ["the other The, then", "", None, *ODD]
    expected = [Tokenizer.from_file(made).encode(t or "", add_special_tokens=False).ids for t in texts]
    got = packing.WordTokens(made, packing.merges_by_rank(made)).batch(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == expected
    assert len(expected[0]) > len(token_ids(texts[0])) - 1
