from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayglass.llm import quality, toxicity

BAD = ("vile", "scorn", "hatred")
PLAIN = [f"{a}{b}" for a in ("ba", "de", "fi", "go", "lu", "ma") for b in ("ra", "ne", "ti", "so", "ku", "vi", "pa")]


def made(spark, n=900):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        toxic, poor = rng.random() < 0.25, rng.random() < 0.3
        words = [rng.choice(PLAIN) for _ in range(rng.randint(20, 60))]
        if toxic:
            words = [rng.choice(BAD) if rng.random() < 0.15 else w for w in words] + ["vile"]
        if poor:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), float(i), "s"))
        if i % 3:
            labels.append((i, int(not poor), int(toxic)))
    rows += [(n, None, None, None), (n + 1, "", 1.0, "s"), (n + 2, "vile " * 50_000, 1.0, "s"), (None, "ba ne", 0.0, "s")]
    labels += [(None, 1, 1), (0, None, None), (3, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, _row string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = made(spark)
    return docs.cache(), labels.cache()


def measured(df, labels, column):
    rows = df.join(labels, "doc_id").where("held_out").where(F.col(column).isNotNull()).collect()
    return np.mean([r.predicted == r[column] for r in rows]), len(rows)


def test_toxicity_holds_out_and_learns(data):
    docs, labels = data
    got = toxicity.toxicity(docs, labels).cache()
    assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "score", "predicted"]
    for r in got.collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    accuracy, n = measured(got, labels, "toxic")
    assert n > 100 and accuracy > 0.8  # three in four are not toxic; some hundred positives to learn from
    # labels of held-out rows change nothing
    flipped = labels.withColumn(
        "toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got.collect())


def test_quality_holds_out_and_learns(data):
    docs, labels = data
    got = quality.quality(docs, labels).cache()
    assert got.count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.collect())
    accuracy, n = measured(got, labels, "quality")
    assert n > 100 and accuracy > 0.95


def test_defined_results_without_labels(data):
    docs, labels = data
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_filters_keep_columns(data):
    docs, labels = data
    clean = toxicity.drop_toxic(docs, labels)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    good = quality.drop_poor(docs, labels)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()


def test_calibration_recovers_the_prior():
    rng = np.random.default_rng(0)
    unlabelled = np.concatenate([rng.normal(2, 1, 300), rng.normal(-2, 1, 2700)])
    a, b = toxicity.calibrate(rng.normal(2, 1, 400), unlabelled, 0.1)
    p = 1 / (1 + np.exp(-(a * unlabelled + b)))
    assert abs(p.mean() - 0.1) < 0.02 and p[:300].mean() > 0.7 > 0.1 > p[300:].mean()


def test_dual_descent_separates():
    rows = [np.array([0]), np.array([1]), np.array([0]), np.array([1])]
    w = quality.fit_dual(rows, [np.ones(1)] * 4, np.array([1, -1, 1, -1]), 2, np.ones(4), 50)
    assert w[0] + w[2] > 0.9 and w[1] + w[2] < -0.9


def test_word_shapes():
    assert quality.word_shape("Word,") == "Aa," and quality.word_shape("x###") == "a##"
    assert quality.word_shape("AB12") == "A0" and len(quality.word_shape("a.b-" * 40)) < 30


def test_all_of_an_unspaced_run_is_read():
    def slots(word):
        return set(toxicity.word_features(word, toxicity.ToxicityParams()))

    # one word deep inside two clauses, beyond their beginnings
    assert slots("今天天气很好我们讨厌他们") & slots("别人说过的话讨厌")
    assert slots("今天天气很好我们") != slots("今天天气很坏他们")
