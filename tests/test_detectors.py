"""Invariants of the detectors and whole runs through files."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from dayglass import config
from dayglass.detectors import isolation_forest, latent, sequence
from dayglass.detectors.lloyd import best_centres
from dayglass.operators import profiles, windows
from dayglass.plans import batch, stages
from dayglass.session import scratch_path
from dayglass.sinks import writers
from dayglass.sources import adapter, logs
from dayglass.streaming.ingest import ingest_new_files

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    """400 ordinary points and one far away."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(400, 3)), columns=["a", "b", "c"])
    pdf["user"] = [f"u{i:03d}" for i in range(400)]
    pdf.loc[len(pdf)] = [9.0, -9.0, 9.0, "odd"]
    pdf["day"] = dt.date(2024, 1, 1)
    pdf["is_anomaly"] = (pdf.user == "odd").astype(int)
    return spark.createDataFrame(pdf)


def top(df):
    return df.orderBy(F.desc("anomaly_score")).first().user


def test_forest_finds_the_planted_point(planted):
    got = isolation_forest.isolation_forest(planted, ["a", "b", "c"])
    assert top(got) == "odd" and got.count() == 401
    r = got.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert -0.5 < r[0] <= r[1] <= 0.5
    assert got.where("user = 'odd'").first().prediction == 1


def test_forest_is_the_same_under_repartitioning(planted):
    def scores(df):
        return {r.user: r.anomaly_score for r in isolation_forest.isolation_forest(df, ["a", "b", "c"]).collect()}

    assert scores(planted) == scores(planted.repartition(7))


def test_forest_with_disjoint_samples(planted):
    small = config.ForestParams(trees=10, sample_size=16)
    got = isolation_forest.isolation_forest(planted, ["a", "b", "c"], params=small)
    assert got.where("user = 'odd'").first().anomaly_score > got.approxQuantile("anomaly_score", [0.9], 0.001)[0]


def test_forest_samples_of_repeated_rows(spark):
    """200 000 rows with 40 distinct ones: full trees that see most of them, drawn in proportion."""
    params = config.ForestParams(trees=50, sample_size=256)
    rows = spark.range(200_000).select(
        (F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40)).cast("double").alias("a"), F.lit("k").alias("k")
    )
    drawn = isolation_forest._samples(rows, ["a"], F.col("k"), params, 200_000, 256).toPandas()
    assert (drawn.groupby("tree").size() == 256).all() and drawn.tree.nunique() == 50
    assert (drawn.groupby("tree").a.nunique() > 30).all()
    # a third of the rows, and 1 / 40 of the rest, have the value 0
    share = (drawn.a == 0).mean()
    assert abs(share - (1 / 3 + 2 / 3 / 40)) < 5 * (0.35 * 0.65 / len(drawn)) ** 0.5
    counts = drawn[drawn.a > 0].a.value_counts()
    assert len(counts) == 39 and counts.min() > 0.7 * counts.mean() and counts.max() < 1.3 * counts.mean()


def test_forest_samples_without_replacement(spark):
    """A sample as large as the table is the table; half of it repeats no more than the table does."""
    params = config.ForestParams(trees=4, sample_size=60)
    rows = spark.createDataFrame([(float(i % 20), "k") for i in range(60)], "a double, k string").repartition(5)
    for size in (60, 30):
        drawn = isolation_forest._samples(rows, ["a"], F.col("k"), params, 60, size).toPandas()
        assert (drawn.groupby("tree").size() == size).all()
        assert drawn.groupby(["tree", "a"]).size().max() <= 3
        assert size < 60 or (drawn.groupby(["tree", "a"]).size() == 3).all()


def test_forest_draws_are_uniform():
    rows = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 100_000)
    for stream in (0, 1, 77):
        u = isolation_forest._uniform(rows, stream, 42)
        assert abs(u.mean() - 0.5) < 0.005 and abs((u < 0.01).mean() - 0.01) < 0.002 and 0 < u.min() and u.max() < 1
    a, b = (isolation_forest._uniform(rows, t, 42) for t in (0, 1))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02


def test_forest_with_few_rows(planted):
    got = isolation_forest.isolation_forest(planted.limit(3), ["a", "b", "c"])
    assert got.count() == 3


def test_mean_path_lengths():
    assert isolation_forest.mean_path(1) == 0 and isolation_forest.mean_path(2) == 1
    assert np.isclose(isolation_forest.mean_path(256), 10.244770920)


def test_latent_clustering_scores(planted):
    params = config.LatentParams(restarts=2, components=2)
    got = latent.latent_clustering(planted, ["a", "b", "c"], params=params)
    r = got.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0.0 <= r[0] < r[1] <= 1.0
    assert got.where("prediction = 1").count() == 20  # strictly above p95 of 401 scores
    low = got.where("prediction = 1").agg(F.min("anomaly_score")).first()[0]
    assert got.where("prediction = 0").agg(F.max("anomaly_score")).first()[0] < low


def test_reconstruction_error_identity(spark, planted):
    from dayglass.operators.scaling import scale

    features = ["a", "b", "c"]
    scaled = scale(planted, features)
    model = latent.fit_latent(scaled, features, config.LatentParams(restarts=1, components=2))
    parts = latent.latent_parts(scaled, model).toPandas()
    x = parts[features].to_numpy()
    pc = model.pca.pc.toArray()
    want = ((x - (x @ pc) @ pc.T) ** 2).mean(axis=1)
    assert np.allclose(parts.reconstruction_error, want)
    z = np.stack(parts.latent)
    centres = np.array(model.centres)
    nearest = np.sqrt(((z[:, None, :] - centres[None]) ** 2).sum(axis=2)).min(axis=1)
    assert np.allclose(parts.distance, nearest)


def planted_windows(spark):
    rng = np.random.default_rng(2)
    rows = []
    for u in range(40):
        for d in range(18):
            x = 50.0 if (u, d) == (7, 17) else float(rng.integers(0, 5))
            rows.append((f"u{u:02d}", dt.date(2024, 1, 1) + dt.timedelta(d), x, float(rng.integers(0, 3)), int((u, d) == (7, 17))))
    daily = spark.createDataFrame(rows, "user string, day date, a double, b double, is_anomaly int")
    return windows.sequences(daily, ["a", "b"])


def test_sequence_detectors_find_the_planted_window(spark):
    found = planted_windows(spark)
    normal = found.where("label = 0")
    assert top(sequence.sequence_deviation(normal, found)) == "u07"
    assert top(sequence.sequence_deviation(normal, found, normal)) == "u07"
    for error in ("absolute", "squared"):
        assert top(sequence.sequence_reconstruction(normal, found, 4, error)) == "u07"


def test_whole_run_through_files(spark):
    events = adapter.activity_log(spark, SF_DIR)
    out = scratch_path(spark, "run")
    got = batch.run_all(
        spark,
        events,
        out,
        directory=adapter.directory(spark, SF_DIR),
        windows=adapter.incidents(spark, SF_DIR),
    )
    daily = profiles.daily_profile(stages.labelled_log(spark, SF_DIR))
    assert got["daily"].count() == daily.count()
    assert spark.read.parquet(f"{out}/unified").count() == events.count()
    models = {r.model for r in spark.read.parquet(f"{out}/predictions").select("model").distinct().collect()}
    assert models == set(config.MODELS)
    assert got["best"].count() == 1 and got["scaler"].count() == 26
    assert spark.read.parquet(f"{out}/ensemble/weighted/comparison").count() == 4


def test_new_files_are_taken_once(spark):
    source, out, marks = (scratch_path(spark, n) for n in ("in", "log", "marks"))
    rows = [("{1}", "01/02/2024 03:04:05", "u", "p", "Logon"), ("{2}", "bad", "u", "p", "Logoff")]
    frame = spark.createDataFrame(rows, "id string, date string, user_id string, pc_id string, activity string")
    for expected in (2, 4, 4):
        if expected != 4 or spark.read.parquet(out).count() == 2:
            frame.coalesce(1).write.mode("append").csv(source)
        ingest_new_files(spark, source, "logon", "r1", out, marks).awaitTermination()
        assert spark.read.parquet(out).count() == expected
    got = spark.read.parquet(out)
    assert got.where("date IS NULL").count() == 2 and got.agg(F.sum("is_logon")).first()[0] == 2


def test_absent_logs_are_skipped(spark):
    root = scratch_path(spark, "raw")
    with pytest.raises(FileNotFoundError):
        logs.read_logs(spark, root, None)
    frame = spark.createDataFrame([("1", "01/02/2024 03:04:05", "a@x", "9")], "id string, date string, from string, size string")
    writers.write_csv(frame, f"{root}/r1/email.csv")
    got = logs.read_logs(spark, root, None).first()
    assert got.user_id == "a@x" and got.email_size_kb == 9 / 1024 and got.has_attachment == 0
    assert logs.find_datasets(spark, root, ["r9"]) == []


def test_equal_rows_are_one_weighted_point(spark, monkeypatch):
    """K-means passes over distinct rows only, and its centres are the means of all rows."""
    seen = []

    class Counted(latent.KMeans):
        def fit(self, dataset, params=None):
            seen.append(dataset.count())
            return super().fit(dataset, params)

    monkeypatch.setattr(latent, "KMeans", Counted)
    rows = [(0.0, 0.0)] * 40 + [(0.0, 1.0)] + [(10.0, 10.0)] * 29 + [(10.0, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    params = config.LatentParams(clusters=2, restarts=3, components=2)
    parts = latent.latent_parts(df, latent.fit_latent(df, ["a", "b"], params)).collect()
    assert seen == [4, 4, 4] and len(parts) == len(rows)
    want = {(0.0, 0.0): 1 / 41, (0.0, 1.0): 40 / 41, (10.0, 10.0): 1 / 30, (10.0, 9.0): 29 / 30}
    assert all(abs(r.distance - want[r.a, r.b]) < 1e-9 for r in parts)


def test_restarts_share_their_passes(spark, monkeypatch):
    """A pass is a round of all restarts, and they end where the best of them ends by itself."""
    seen = []

    class Kept(latent.KMeans):
        def fit(self, dataset, params=None):
            seen.append(dataset)
            return super().fit(dataset, params)

    def jobs() -> int:
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup(), default=-1)

    monkeypatch.setattr(latent, "KMeans", Kept)
    rows = np.random.default_rng(11).normal(size=(3000, 4)) * [1.0, 0.9, 0.8, 0.7]
    features = ["a", "b", "c", "d"]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=features)).repartition(5)
    params = config.LatentParams(restarts=6, components=4)
    before = jobs()
    found = latent.fit_latent(df, features, params)
    ran = jobs() - before
    alone = [
        KMeans(k=params.clusters, maxIter=params.max_iter, seed=params.seed + i, featuresCol="z", weightCol="_weight").fit(seen[0])
        for i in range(params.restarts)
    ]
    best = min(alone, key=lambda m: m.summary.trainingCost)
    assert ran < 0.7 * sum(m.summary.numIter for m in alone)
    assert np.allclose(found.centres, best.clusterCenters(), rtol=0, atol=1e-9)


def test_fewer_points_than_clusters(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 1.0), (5.0, -2.0)], "a double, b double").repartition(3)
    found = latent.fit_latent(df, ["a", "b"], config.LatentParams(restarts=2, components=2))
    assert len(found.centres) == 2
    assert latent.latent_parts(df, found).agg(F.max("distance")).first()[0] < 1e-9


def test_rounds_keep_empty_centres_and_stop_by_count(spark):
    """Ties go to the first centre; a centre without points stays; the rounds end at the bound."""
    points = spark.createDataFrame([([-1.0], 1.0), ([1.0], 3.0), ([3.0], 1.0)], "latent array<double>, _weight double")
    start = np.array([[0.0], [2.0], [50.0]])
    assert best_centres(points, [start], 1, 1e-4) == [[0.5], [3.0], [50.0]]
    assert best_centres(points, [start[:2], start], 0, 1e-4) == [[0.0], [2.0]]
