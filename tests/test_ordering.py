"""Distributed orderings against NumPy, with ties, skew and many ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayglass.operators import ordering


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(7)
    n = 3000
    # one group and one value each hold a third or more of the rows
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "g": np.where(rng.random(n) < 0.6, "big", rng.choice(["a", "b"], n)),
            "v": np.where(rng.random(n) < 0.4, 0.5, rng.normal(size=n).round(3)),
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("ranges", [2, 40])
def test_running_counts(scores, descending, ranges):
    pdf, df = scores
    got = ordering.cumulative_counts(
        df, "v", {"n": F.count(F.lit(1))}, ("g",), descending, ranges
    ).toPandas()
    for g, part in pdf.groupby("g"):
        want = part.v.value_counts().sort_index(ascending=not descending)
        mine = got[got.g == g].sort_values("v", ascending=not descending)
        assert mine.n.tolist() == want.tolist()
        assert mine.cum_n.tolist() == want.cumsum().tolist()


@pytest.mark.parametrize("ranges", [2, 40])
def test_row_numbers(scores, ranges):
    pdf, df = scores
    got = ordering.row_numbers(df, [-F.col("v"), F.col("id")], ("g",), ranges=ranges).toPandas()
    for g, part in got.groupby("g"):
        part = part.sort_values(["v", "id"], ascending=[False, True])
        assert part.row_number.tolist() == list(range(1, len(part) + 1))
    assert len(got) == len(pdf)


def test_row_numbers_of_text_keys(spark):
    names = [f"user-{i:05d}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names], "u string").repartition(4)
    got = {r.u: r.row_number for r in ordering.row_numbers(df, [F.col("u")]).collect()}
    assert [got[n] for n in names] == list(range(1, 501))


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0)], "g string, v double")
    got = ordering.cumulative_counts(df, "v", {"n": F.count(F.lit(1))}, ("g",)).collect()
    assert sorted((r.g or "", r.v, r.cum_n) for r in got) == [("", 1.0, 1), ("", 2.0, 2), ("a", 1.0, 1)]


def test_quantiles(scores):
    pdf, df = scores
    probs = {"q0": 0.0, "q5": 0.5, "q95": 0.95, "q1": 1.0}
    for r in ordering.quantiles(df, "v", probs, ("g",)).collect():
        want = np.quantile(pdf[pdf.g == r.g].v, list(probs.values()))
        assert np.allclose([r[k] for k in probs], want)
    one = ordering.quantiles(df, "v", {"q": 0.37}).first().q
    assert np.isclose(one, np.quantile(pdf.v, 0.37))


@pytest.mark.parametrize("steps", [7, 1000])
def test_quantile_grid(scores, steps):
    pdf, df = scores
    got = ordering.quantile_grid(df, "v", steps, ("g",)).toPandas()
    for g, part in got.groupby("g"):
        want = np.quantile(pdf[pdf.g == g].v, np.linspace(0, 1, steps))
        assert np.allclose(part.sort_values("step")["quantile"], want)


@pytest.mark.parametrize("accuracy", [50, 400])
def test_quantiles_count_inside_brackets_only(spark, scores, accuracy, monkeypatch):
    """Many values between few brackets: exact, and few cells."""
    monkeypatch.setattr(ordering, "SKETCH_ACCURACY", accuracy)
    monkeypatch.setattr(ordering, "_ACCURACY_PER_POINT", 1)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 20_000, p=[0.9, 0.1]), "v": rng.normal(size=20_000)})
    pdf.loc[rng.random(20_000) < 0.3, "v"] = 0.25
    df = spark.createDataFrame(pdf).repartition(7)
    probs = {"q0": 0.0, "q1": 0.01, "q5": 0.5, "q95": 0.95, "q99": 0.9999, "q100": 1.0}
    for r in ordering.quantiles(df, "v", probs, ("g",)).collect():
        assert np.allclose([r[k] for k in probs], np.quantile(pdf[pdf.g == r.g].v, list(probs.values())), rtol=0, atol=1e-14)
    grid = ordering.quantile_grid(df, "v", 21, ("g",)).toPandas()
    for g, part in grid.groupby("g"):
        assert np.allclose(part.sort_values("step")["quantile"], np.quantile(pdf[pdf.g == g].v, np.linspace(0, 1, 21)))
    cells, _ = ordering._cells(df, "v", [0.5, 0.95], ["g"])
    assert cells.count() < 20_000 * 2 * 7 / accuracy + 10


def test_an_input_is_planned_once(spark, scores):
    """A costly input runs once, whatever is asked of it."""
    _, df = scores
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    counted = df.mapInPandas(count, df.schema)
    ordering.row_numbers(counted, [F.col("v"), F.col("id")], ("g",)).collect()
    ordering.quantiles(counted, "v", {"a": 0.3, "b": 0.7}, ("g",)).collect()
    ordering.cumulative_counts(counted, "v", {"n": F.count(F.lit(1))}, ("g",)).collect()
    assert seen.value == 3 * 3000


def test_row_numbers_shuffle_rows_once(scores):
    _, df = scores
    plan = ordering.row_numbers(df, [F.col("id")], ("g",))._jdf.queryExecution().executedPlan().toString()
    # what is left to shuffle are the totals of ranges, a few rows
    assert plan.count("rangepartitioning") == 0 and plan.count("Exchange hashpartitioning") <= 2


def test_quantile_of_single_row(spark):
    df = spark.createDataFrame([("a", 3.0)], "g string, v double")
    assert ordering.quantiles(df, "v", {"q": 0.95}, ("g",)).first().q == 3.0
    assert {r["quantile"] for r in ordering.quantile_grid(df, "v", 5, ("g",)).collect()} == {3.0}


def test_top_rows(scores):
    pdf, df = scores
    got = ordering.top_rows(df, [F.desc("v"), F.asc("id")], 25, ("g",)).toPandas()
    for g, part in got.groupby("g"):
        want = pdf[pdf.g == g].sort_values(["v", "id"], ascending=[False, True]).id[:25]
        assert part.sort_values("rank").id.tolist() == want.tolist()


def test_hash_sample_ignores_partitioning(scores):
    _, df = scores
    a = {r.id for r in ordering.hash_sample(df, F.col("id"), 100).collect()}
    b = {r.id for r in ordering.hash_sample(df.repartition(11), F.col("id"), 100).collect()}
    assert a == b and len(a) == 100
    assert ordering.hash_sample(df, F.col("id"), 10**6).count() == 3000


def test_hash_sample_of_repeated_keys_is_exact(spark):
    df = spark.range(100_000).select((F.col("id") % 50).alias("k"), "id")
    for n in (300, 1000, 5000):
        rows = ordering.hash_sample(df, F.col("k"), n).collect()
        assert len(rows) == n == len({r.id for r in rows})
    same = spark.range(1000).select(F.lit(1).alias("k"))
    assert ordering.hash_sample(same, F.col("k"), 10).count() == 10


def test_group_stats_of_many_groups_and_nulls(spark):
    df = spark.range(24_000).select(F.when(F.col("id") % 12_000 > 0, F.col("id") % 12_000).alias("k"), "id")
    got = ordering.with_group_stats(df, ["k"], {"n": F.count(F.lit(1))})
    assert got.count() == 24_000 and got.where("n = 2").count() == 24_000


def test_count_below_over_many_blocks(spark):
    points = spark.range(0, 200, 2).select(F.col("id").cast("double").alias("p"))
    values = spark.range(0, 210).select(F.col("id").cast("double").alias("x"))
    array = points.agg(F.sort_array(F.collect_set("p")).alias("points"))
    blocks = array.select(F.struct("points", ordering._block_heads("points").alias("heads")).alias("t"))
    bound = values.crossJoin(blocks)
    for r in bound.select("x", ordering.count_below("t", F.col("x")).alias("n")).collect():
        assert r.n == sum(1 for p in range(0, 200, 2) if p < r.x)
