from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from dayglass.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, _x int"


def brute(rows, every, rule=hn.Rule(), scale=256):
    kept = set()
    for k, v, label, *_ in rows:
        if k is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.add((k, label, tuple(math.floor(scale * float(c)) for c in v)))
    out = []
    for k, label, q in kept:
        if k % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i, other == label) for i, other, v in kept if i != k)
        for s, p, _ in [t for t in scores if t[2]][: rule.positives]:
            inside = [t for t in scores if not t[2] and rule.low * -s <= rule.unit * -t[0] <= rule.high * -s]
            out += [(k, p, r + 1, t[1], -s, -t[0]) for r, t in enumerate(inside[: rule.negatives])]
    return sorted(out)


def shown(df):
    columns = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def near(rng, centre, spread):
    # quarters of the scale, so floats are exact and many scores are equal
    return [round((c + rng.gauss(0, spread)) * 64) / 64 for c in centre]


def made(seed, n, d, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 0, 1, 2, 3])  # a hot label
        rows.append((i, near(rng, centres[(label + rng.choice([0, 0, 1])) % 4], spread), label, "r", i))
    common = near(rng, centres[0], spread)
    rows += [(n + i, common, i % 3, "common", None) for i in range(n // 4)]  # one vector very often
    return rows


@pytest.mark.parametrize(("seed", "d", "block", "round_size"), [(1, 20, 4096, 8192), (2, 20, 16, 7), (3, 3, 5, 4), (4, 33, 40, 30)])
def test_matches_brute_force(spark, seed, d, block, round_size):
    rows = made(seed, 160, d)
    df = spark.createDataFrame(rows, SCHEMA)
    assert shown(hn.mine(df, F.col("_id") % 5 == 0, block=block, round_size=round_size)) == brute(rows, 5)


def test_awkward_rows(spark):
    rng = random.Random(9)
    rows = made(5, 40, 6)
    rows += [rows[0], rows[0], rows[5]]  # repeated rows
    rows += [(None, [1.0] * 6, 1, "x", 1), (700, None, 1, "x", 1), (705, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, "x", 1)]
    rows += [(710, [1.0, math.nan, 1.0, 1.0, 1.0, 1.0], 1, "x", 1), (715, [math.inf, 1.0, 1.0, 1.0, 1.0, 1.0], 1, "x", 1), (720, [1.0] * 6, None, "x", 1)]
    rows += [(800, [-c for c in near(rng, [1] * 6, 0.1)], 77, "alone", 1)]  # no positive
    rows += [(900, [0.0] * 6, 1, "zero", 1), (5, near(rng, [1] * 6, 0.1), 1, "same id", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert shown(hn.mine(df, F.col("_id") % 5 == 0, block=9, round_size=6)) == brute(rows, 5)
    assert hn.mine(df.limit(0), F.col("_id") % 5 == 0).count() == 0
    assert hn.mine(df, F.lit(False)).count() == 0


def test_large_components(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-60_000, 60_000)) for _ in range(40)], i % 2, "", 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert shown(hn.mine(df, F.col("_id") % 5 == 0, block=16)) == brute(rows, 5)
    with pytest.raises(OverflowError):
        hn.mine(spark.createDataFrame([(i, [1e15], 1, "", 0) for i in range(2)], SCHEMA), F.lit(True))
    with pytest.raises(ValueError, match="unlike"):
        hn.mine(spark.createDataFrame([(1, [1.0], 1, "", 0), (2, [1.0, 2.0], 1, "", 0)], SCHEMA), F.lit(True))


def test_other_rules(spark):
    rows = made(8, 120, 10)
    rule = hn.Rule(positives=2, negatives=7, low=0, high=100)
    df = spark.createDataFrame(rows, SCHEMA)
    assert shown(hn.mine(df, F.col("_id") % 4 == 0, rule=rule, block=20)) == brute(rows, 4, rule)


def test_scan_leaves_candidates_out():
    """The bounds do shrink the candidate set, and lose none that matters."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(-100, 100, (500, 64)).astype(float)
    x[:5] = np.sign(x[:5]) * 100
    block = hn._Block(np.arange(500), np.zeros(500, dtype=np.int64), np.ascontiguousarray(x.T), x.min(axis=0), x.max(axis=0))
    for q in x[:5]:
        scores = x @ q
        at, score = block.scan(q, np.arange(500), -np.inf, np.inf, 5)
        assert len(at) < 500 and (scores[at] == score).all()
        assert set(np.argsort(-scores, kind="stable")[:5]) <= set(at.tolist())
        middle = np.quantile(scores, [0.6, 0.9])
        at, _ = block.scan(q, np.arange(500), *middle, None)
        assert set(at.tolist()) == set(np.flatnonzero((scores >= middle[0]) & (scores <= middle[1])).tolist())
