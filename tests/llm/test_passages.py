from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from dayglass.llm import substring_dedup as sd

ENDS = ".!?\n。！？"


def units(text):
    """(start, end, normalised words) by walking over the text."""
    out, start, i = [], 0, 0
    text = text or ""
    while i < len(text):
        if text[i] in ENDS:
            while i < len(text) and text[i] in ENDS:
                i += 1
            out.append((start, i))
            start = i
        else:
            i += 1
    if start < len(text):
        out.append((start, len(text)))
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    found = [(a, b, tuple(re.findall("[0-9a-z\x80-\U0010ffff]+", lowered[a:b]))) for a, b in out]
    return [u for u in found if u[2]]


def brute(rows, min_words=3, run_words=20):
    """Per row: removed spans and the text that stays."""
    cut = [units(t) for _, t in rows]
    first = {}
    for (k, _), own in zip(rows, cut):
        for place, (_, _, words) in enumerate(own):
            rank = (k is None, k or 0, place)
            first[words] = min(first.get(words, rank), rank)
    out = []
    for (k, text), own in zip(rows, cut):
        runs, run = [], []
        for place, unit in enumerate(own):
            if first[unit[2]] != (k is None, k or 0, place):
                run.append(unit)
            elif run:
                runs.append(run)
                run = []
        spans = []
        for run in [*runs, run]:
            weights = [max(len(w), sum(map(len, w)) // 8) for _, _, w in run]
            if run and sum(w for w in weights if w >= min_words) >= run_words:
                spans.append((run[0][0], run[-1][1]))
        left = text
        for a, b in reversed(spans):
            left = left[:a] + left[b:]
        out.append((str(k), text or "", [(a, b - a) for a, b in spans], left))
    return sorted(out, key=repr)


def shown(df):
    rows = df.select("_id", "_text", "_cleaned", "_removed").collect()
    return sorted(((str(r._id), r._text or "", [(u.start, u.length) for u in r._removed or []], r._cleaned) for r in rows), key=repr)


def sentence(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "ünï", "delta", "e5", "日本語"]) + str(rng.randint(0, 400)) for _ in range(n)) + rng.choice([". ", "!! ", "?\n", "\n\n", "。"])


def made(seed):
    rng = random.Random(seed)
    passages = ["".join(sentence(rng, rng.randint(1, 14)) for _ in range(8)) for _ in range(4)]
    common = [sentence(rng, n) for n in (1, 2, 4)]
    rows = []
    for k in range(60):
        text = "".join(rng.choice([sentence(rng, rng.randint(1, 15)), rng.choice(common)]) for _ in range(rng.randint(0, 12)))
        if rng.random() < 0.5:
            text += rng.choice(passages) + "".join(sentence(rng, 6) for _ in range(2)) + rng.choice(passages)[rng.randint(0, 60) :]
        rows.append((k, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = shown(sd.passage_dedup(df))
    assert got == brute(rows) and any(spans for _, _, spans, _ in got)


def test_a_passage_inside_longer_lines_goes_and_common_sentences_stay(spark):
    passage = "The first sentence of it has nine words here. Yes! And the second one goes on for ten words more."
    rows = [(1, f"Before it. {passage} After."), (2, f"Own words.\nOther start. {passage} Other end.\nYes!"), (3, "Yes! Yes! Before it. After.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sd.drop_passages(df, run_words=19).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2] == "Own words.\nOther start. Other end.\nYes!"


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert shown(sd.passage_dedup(awkward)) == brute(rows)
    kept = sd.drop_passages(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert sd.drop_passages(nothing).count() == 0


def test_rows_that_share_an_id(spark):
    passage = " ".join(f"word{i}" for i in range(30)) + "."
    rows = [(1, passage), (2, f"Own text here.{passage}"), (2, "another row of this id"), (None, f"none. {passage}"), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(sd.passage_dedup(df)) == brute(rows)
    assert sd.drop_passages(df).where(F.col("doc_id") == 2).count() == 2


def test_writing_without_spaces_counts_by_its_length(spark):
    passage = "".join(chr(0x4E00 + i * 7) for i in range(200)) + "。"
    rows = [(1, passage), (2, "開始。" + passage)]
    got = {r.doc_id: r.text for r in sd.drop_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: passage, 2: "開始。"}
