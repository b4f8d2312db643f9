"""Every stage of the pipeline against a brute-force version, on the smallest tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontamination import brute as brute_hits

import corpus_pipeline
from dayglass.llm import packing, simhash, toxicity
from dayglass.llm.common import table
from dayglass.session import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The documents before the first stage and after each stage but the last."""
    docs = table(spark, SF, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert all(df.columns == kept[0].columns for df in kept)
    assert all(0 < b.count() <= a.count() for a, b in zip(kept, kept[1:]))


def test_toxic_documents_go(spark, kept):
    scores = toxicity.toxicity(kept[0], table(spark, SF, "labels")).collect()
    assert set(texts(kept[1])) == {r.doc_id for r in scores if r.score < 0.7}


def test_one_of_equal_texts_stays(kept):
    want = {}
    for d, t in texts(kept[1]).items():
        want[t] = max(d, want.get(t, d))
    assert set(texts(kept[2])) == set(want.values())


def test_near_copies_go(kept):
    before, after = texts(kept[2]), texts(kept[3])
    sets = {d: set(simhash.shingles(t, 5)) for d, t in before.items()}

    def similarity(a, b):
        return len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))

    # one document, the smallest id, of each component of exact similarity stays
    root = {d: d for d in before}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(before)
    for i, b in enumerate(order):
        for a in order[:i]:
            if not sets[a] | sets[b] or similarity(a, b) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {find(d) for d in before}


def test_benchmark_passages_go(spark, kept):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = {d for d, t in texts(kept[3]).items() if not brute_hits(t, items)[1]}
    assert set(texts(kept[4])) == want


def test_all_that_is_left_is_packed(spark, kept):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    left = texts(kept[4])
    rows = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF).collect()
    sizes = {d: len(b) // 4 + 1 for d, b in zip(left, packing.WordTokens(path).batch(list(left.values())))}
    placed = {}
    for r in rows:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.length
    assert placed == sizes


def test_clashing_columns_and_awkward_rows_pass_all_stages(spark, awkward):
    names = ["_text", "_hash", "_marked", "_digest", "_key", "_node", "_word", "_at"]
    docs = awkward
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(f"own {i}"))
    before = {str(r.doc_id): r for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "awkward-stage")
        assert docs.columns == [*awkward.columns, *names]
    left = docs.collect()
    # copies, texts without words and the repeated row are gone; the rest is as it was
    ids = sorted(str(r.doc_id) for r in left)
    assert len(ids) == len(set(ids)) and set(ids) <= set(before)
    assert all(r == before[str(r.doc_id)] for r in left)
    assert {"5", "6", "8", "None"} <= set(ids) and len({"1", "2"} & set(ids)) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == len(left)


def test_an_empty_table_passes_all_stages(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == nothing.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """The stage searches fingerprints: what they link hangs together without any band, if similar enough."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(4_000)]
    rows = [(k, " ".join([*base, f"own{k}"])) for k in range(5)]
    rows += [(10 + k, " ".join(f"x{rng.random()}" for _ in range(300))) for k in range(3)]
    # one phrase over and over: equal fingerprints, unlike sets of shingles
    phrase = " ".join(f"p{i}" for i in range(11))
    rows += [(20 + k, " ".join([phrase] * 400 + [f"y{k}x{i}" for i in range(30)])) for k in range(2)]
    prints = {d: simhash.fingerprint(t) & (1 << 64) - 1 for d, t in rows}

    def apart(a, b):
        return bin(prints[a] ^ prints[b]).count("1")

    assert all(apart(0, k) <= 2 for k in range(5)) and len({prints[k] for k in range(5)}) > 1
    assert apart(20, 21) <= 2 and apart(0, 10) > 2
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: np.empty(0, dtype=np.int64))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(texts(corpus_pipeline.drop_near(spark, docs, SF))) == {0, 10, 11, 12, 20, 21}
