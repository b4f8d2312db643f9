"""Edge cases on literal frames."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayglass import config
from dayglass.functions import numeric, text
from dayglass.operators import (
    alerts,
    cleaning,
    ensemble,
    evaluation,
    labelling,
    moments,
    profiles,
    scaling,
    splits,
    weight_search,
    windows,
)

T = dt.datetime
LOG = "user_id string, date timestamp_ntz, activity string, pc_id string, dataset string"


def test_dates_in_two_layouts(spark):
    rows = ["01/02/2010 03:04:05", "2010-01-02 03:04:05", "2010-01-02", "n/a", None, "13/45/2010 00:00:00"]
    df = spark.createDataFrame([(r,) for r in rows], "d string")
    got = [r[0] for r in df.select(text.parse_activity_time(F.col("d"))).collect()]
    assert got == [T(2010, 1, 2, 3, 4, 5), T(2010, 1, 2, 3, 4, 5), None, None, None, None]


def test_host_and_extension(spark):
    df = spark.createDataFrame([("http://A.vpn.example/x", "a.b.PDF"), ("ftp://x/y", "README")], "u string, f string")
    host = text.url_host(F.col("u"))
    ext = text.file_extension(F.col("f"))
    got = df.select(host, text.is_suspicious_host(host), ext, text.is_sensitive_extension(ext)).collect()
    assert [tuple(r) for r in got] == [("A.vpn.example", 1, "pdf", 1), (None, None, "readme", 0)]


def test_pseudonym_of_null(spark):
    df = spark.createDataFrame([("x",), (None,)], "u string")
    first, second = (r[0] for r in df.select(text.pseudonym(F.col("u"))).collect())
    assert first.startswith("USER_") and len(first) == 17 and second == "UNKNOWN"


def test_daily_profile_null_rules(spark):
    rows = [
        ("u", T(2024, 1, 1, 6), None, None, "r1"),
        ("u", T(2024, 1, 1, 20), "Logon", "p1", "r1"),
        ("u", T(2024, 1, 1, 12), "Logon", "p1", "r1"),
        ("u", None, "Logon", "p9", "r1"),
    ]
    got = profiles.daily_profile(spark.createDataFrame(rows, LOG)).collect()
    assert len(got) == 1
    r = got[0]
    assert r.daily_activity_count == 2  # null activity is not counted
    assert r.unique_pcs == 2  # null counts as one value
    assert (r.first_activity_hour, r.last_activity_hour, r.work_duration_hours) == (6, 20, 14)
    assert r.after_hours_activity == 2 and r.logon_count == 2 and r.unique_ips == 0


def test_window_labels(spark):
    rows = [
        ("u", T(2024, 1, 10), "a", "p", "r1"),  # on the start
        ("u", T(2024, 1, 14, 12), "a", "p", "r1"),  # on the end
        ("u", T(2024, 1, 12, 1), "a", "p", "r1"),  # in two windows
        ("u", T(2024, 1, 14, 12, 0, 1), "a", "p", "r1"),
        ("u", T(2024, 1, 12, 1), "a", "p", "r2"),  # other dataset
        ("u", T(2024, 3, 5), "a", "p", "r1"),  # inside the long window
        ("v", T(2024, 1, 12, 1), "a", "p", "r1"),
        ("u", None, "a", "p", "r1"),
    ]
    win = spark.createDataFrame(
        [
            ("u", "r1", T(2024, 1, 10), T(2024, 1, 12, 23, 59, 59)),
            ("u", "r1", T(2024, 1, 12), T(2024, 1, 14, 12)),
            ("u", "r1", T(2024, 2, 1), T(2024, 4, 1)),
            ("u", "r1", T(2024, 1, 20), T(2024, 1, 19)),  # ends before it starts
        ],
        "user_id string, dataset string, start timestamp_ntz, end timestamp_ntz",
    )
    got = labelling.label_by_windows(spark.createDataFrame(rows, LOG), win).collect()
    assert len(got) == len(rows)
    assert sum(r.is_insider for r in got) == 4
    assert all(r.is_insider == 0 for r in got if r.dataset == "r2" or r.user_id == "v" or r.date is None)


def test_many_windows_of_one_user_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = T(2024, 1, 1)
    spans = []
    for _ in range(300):
        a = base + dt.timedelta(minutes=int(rng.integers(0, 200_000)))
        spans.append((a, a + dt.timedelta(minutes=int(rng.integers(0, 900)))))
    times = [base + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 200_000, 500)]
    win = spark.createDataFrame([("u", "r1", a, b) for a, b in spans], "user_id string, dataset string, start timestamp_ntz, end timestamp_ntz")
    log = spark.createDataFrame([("u", t, "a", "p", "r1") for t in times], LOG)
    got = labelling.label_by_windows(log, win).collect()
    want = {t: int(any(a <= t <= b for a, b in spans)) for t in times}
    assert len(got) == 500 and all(r.is_insider == want[r.date] for r in got)
    merged = sorted((r.start, r.end) for r in labelling.merge_windows(win, ["user_id", "dataset"]).collect())
    assert all(a[1] < b[0] for a, b in zip(merged, merged[1:]))


def test_labels_are_only_raised(spark):
    log = spark.createDataFrame([("u", T(2024, 5, 1), 1)], "user_id string, date timestamp_ntz, is_insider int")
    win = spark.createDataFrame([("u", T(2024, 1, 1), T(2024, 1, 2))], "user_id string, start timestamp_ntz, end timestamp_ntz")
    assert labelling.label_by_windows(log, win, ("user_id",)).first().is_insider == 1


def test_static_profile_of_one_day(spark):
    daily = spark.createDataFrame([("u", dt.date(2024, 1, 1), 5)], "user string, day date, m long")
    r = profiles.static_profile(daily).first()
    assert (r.m_mean, r.m_std) == (5.0, 0.0)


def test_scaling_keeps_constant_features(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0), (5.0, 7.0)], "a double, c double")
    got = scaling.scale(df, ["a", "c"]).collect()
    a = np.array([1.0, 2, 4, 5])
    assert np.allclose(sorted(r.a for r in got), (a - a.mean()) / a.std())
    assert {r.c for r in got} == {0.0}


def test_scaler_falls_back_when_features_differ(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "a double")
    other = scaling.fit_scaler(spark.createDataFrame([(9.0,)], "b double"), ["b"])
    assert sorted(r.a for r in scaling.scale(df, ["a"], other).collect()) == [-1.0, 1.0]


def test_sequences_need_enough_days(spark):
    rows = [("short", dt.date(2024, 1, 1) + dt.timedelta(i), i, 0) for i in range(14)]
    rows += [("exact", dt.date(2024, 1, 1) + dt.timedelta(i), i, int(i == 3)) for i in range(15)]
    daily = spark.createDataFrame(rows, "user string, day date, m long, is_anomaly int")
    last = windows.sequences(daily, ["m"]).collect()
    assert [(r.user, r.label) for r in last] == [("exact", 0)]
    assert [x[0] for x in last[0].seq] == [float(i) for i in range(15)]
    assert windows.sequences(daily, ["m"], label_rule="any").first().label == 1
    assert windows.sequences(daily.where("user = 'short'"), ["m"]).count() == 0


def test_stride_counts_from_the_first_row(spark):
    rows = [("u", dt.date(2024, 1, 1) + dt.timedelta(i), i) for i in range(36)]
    daily = spark.createDataFrame(rows, "user string, day date, m long")
    ends = [r.seq[0][0] for r in windows.sequences(daily, ["m"], stride=10, label=None).orderBy("end_day").collect()]
    assert ends == [0.0, 10.0, 20.0]


def test_peer_zscores_equal_a_window(spark):
    rng = np.random.default_rng(0)
    rows = [(f"u{i}", "r" if i % 3 else "s", dt.date(2024, 1, 1 + i % 4), float(rng.integers(0, 9))) for i in range(80)]
    daily = spark.createDataFrame(rows, "user_id string, role string, date date, m double")
    got = daily.toPandas()
    mean = got.groupby(["role", "date"]).m.transform("mean")
    std = got.groupby(["role", "date"]).m.transform("std").fillna(0)
    got["want"] = (got.m - mean) / (std + 1e-10)
    mine = windows.peer_zscores(daily, ["m"]).toPandas().merge(got, on=["user_id"])
    assert np.allclose(mine.m_zscore_peer, mine.want)


def test_keep_one_with_null_order(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", "a", 2), ("k", "b", 3)], "k string, o string, v int")
    assert cleaning.keep_one(df, ["k"], [F.col("o")], "last").first().v == 3
    assert cleaning.keep_one(df, ["k"], [F.col("o")], "first").first().v == 1


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert sorted(r.c for r in cleaning.fill_missing(df, "fill_mode").collect()) == ["a", "a", "b"]
    with pytest.raises(ValueError):
        cleaning.fill_missing(df, "guess")


def test_binary_labels(spark):
    df = spark.createDataFrame([("2",), ("4",), ("0",), (None,), ("x",), ("-1",)], "y string")
    assert [r[0] for r in df.select(numeric.binary_label(F.col("y"))).collect()] == [1, 1, 0, 0, 0, 0]


def test_split_ratios(spark):
    with pytest.raises(ValueError):
        splits.assign_split(spark.range(3), F.col("id"), 0.5, 0.1, 0.1)
    counts = {r.split: r.n for r in splits.assign_split(spark.range(20000), F.col("id")).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(counts["train"] / 20000 - 0.7) < 0.02 and abs(counts["val"] / 20000 - 0.15) < 0.02


# --- severity, ensembles, evaluation ----------------------------------------

PRED = "model string, user string, day date, true_label int, prediction int, anomaly_score double"
DAY = dt.date(2024, 1, 1)


def test_severity_bands(spark):
    df = spark.createDataFrame([(0.8,), (1.2,), (0.85,), (0.98,), (0.99,), (0.1,)], "s double")
    got = [r[0] for r in df.select(alerts.severity(F.col("s"))).collect()]
    assert got == ["low", "low", "medium", "high", "critical", "low"]


def test_alert_ids_are_not_cut(spark):
    df = spark.createDataFrame([(7,), (1234567,)], "i long")
    assert [r[0] for r in df.select(alerts.alert_id(F.col("i"))).collect()] == ["ALERT_000007", "ALERT_1234567"]


def test_no_alert_gives_an_empty_typed_table(spark):
    rows = [("isolation_forest", "u", DAY, 0, 0, 0.1)]
    found = alerts.make_alerts(ensemble.combine(spark.createDataFrame(rows, PRED)))
    assert found.count() == 0 and "severity" in found.columns


def test_missing_model_for_a_key(spark):
    rows = [
        ("isolation_forest", "u", DAY, 1, 1, 0.9),
        ("deep_clustering", "u", DAY, 1, 1, 0.5),
        ("isolation_forest", "v", DAY, 0, 1, 0.6),
    ]
    df = spark.createDataFrame(rows, PRED)
    got = {r.user: r for r in ensemble.combine(df, "weighted").collect()}
    assert np.isclose(got["u"].anomaly_score, (0.9 * 0.3 + 0.5 * 0.3) / 0.6)
    assert np.isclose(got["v"].anomaly_score, 0.6)
    assert got["u"].contributing_models == ["isolation_forest", "deep_clustering"]
    got = {r.user: r for r in ensemble.combine(df, "cascade").collect()}
    assert (got["u"].prediction, got["u"].anomaly_score) == (1, 0.9)
    with pytest.raises(ValueError):
        ensemble.combine(df, "other")


def test_unknown_model_weight(spark):
    rows = [("isolation_forest", "u", DAY, 0, 0, 1.0), ("new", "u", DAY, 0, 0, 0.0)]
    r = ensemble.combine(spark.createDataFrame(rows, PRED), models=("isolation_forest", "new")).first()
    assert np.isclose(r.anomaly_score, 0.3 / 0.8)


@pytest.mark.parametrize("sizes", [(10, 4), (7, 7), (5, 1), (1000, 37), (2, 1)])
def test_positional_alignment(spark, sizes):
    long, short = sizes
    rows = [("isolation_forest", f"u{i:04d}", DAY, 0, 0, float(i)) for i in range(long)]
    rows += [("deep_clustering", f"u{i:04d}", DAY, 0, 0, float(i)) for i in range(short)]
    got = ensemble.align_by_position(spark.createDataFrame(rows, PRED)).toPandas()
    mine = got[got.model == "isolation_forest"].sort_values("position")
    want = np.linspace(0, long - 1, short, dtype=int)
    assert mine.position.tolist() == list(range(short))
    assert mine.anomaly_score.astype(int).tolist() == want.tolist()


def test_weight_choices():
    choices = ensemble.weight_choices(("a", "b", "c"))
    assert len(choices) == 66 and all(abs(sum(c) - 1) < 1e-9 for c in choices)


def frame(spark, labels, scores, flags=None):
    flags = flags or [int(s > 0.5) for s in scores]
    rows = [
        ("isolation_forest", f"u{i:03d}", DAY, int(y), int(p), float(s))
        for i, (y, p, s) in enumerate(zip(labels, flags, scores))
    ]
    return spark.createDataFrame(rows, PRED)


def test_metrics_with_ties(spark):
    # pairs: (0.9 vs 0.5, 0.1) and (0.5 vs 0.5 tie, 0.1): 3.5 of 4
    m = evaluation.metrics(frame(spark, [1, 1, 0, 0], [0.9, 0.5, 0.5, 0.1])).first()
    assert m.auc_roc == 0.875 and m.precision == 1.0 and m.recall == 0.5
    assert (m.true_negatives, m.false_positives, m.false_negatives, m.true_positives) == (2, 0, 1, 1)


def test_metrics_with_one_class(spark):
    m = evaluation.metrics(frame(spark, [0, 0], [0.1, 0.2])).first()
    assert m.auc_roc == 0.0 and m.accuracy == 1.0 and m.true_negatives == 0
    m = evaluation.metrics(frame(spark, [0, 0], [0.1, 0.9])).first()
    assert m.true_negatives == 1 and m.false_positives == 1


def test_metrics_with_larger_labels(spark):
    m = evaluation.metrics(frame(spark, [3, 0], [0.9, 0.1])).first()
    assert m.true_positives == 1 and m.f1_score == 1.0


def brute_sweep(y, s, thresholds, inclusive=False):
    out = []
    for t in thresholds:
        p = s >= t if inclusive else s > t
        tp, fp, fn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
        out.append((tp, fp, fn))
    return out


def test_sweeps_match_brute_force(spark):
    rng = np.random.default_rng(11)
    y = (rng.random(400) < 0.2).astype(int)
    s = (rng.random(400) + 0.3 * y).round(3)
    df = frame(spark, y, s)
    sweep = evaluation.threshold_sweep(df).orderBy("step").collect()
    grid = np.linspace(s.min(), s.max(), 100)
    assert np.allclose([r.threshold for r in sweep], grid)
    assert [(r.tp, r.fp, r.fn) for r in sweep] == brute_sweep(y, s, grid)
    fixed = evaluation.threshold_sweep(df, 100, 0.9, 0.999).orderBy("step").collect()
    assert [(r.tp, r.fp, r.fn) for r in fixed] == brute_sweep(y, s, np.linspace(0.9, 0.999, 100))
    every = evaluation.candidate_sweep(df).orderBy("step").collect()
    assert [r.threshold for r in every] == sorted(set(s))
    assert [(r.tp, r.fp, r.fn) for r in every] == brute_sweep(y, s, sorted(set(s)))
    few = evaluation.quantile_sweep(df, 50).orderBy("step").collect()
    want = np.unique(np.quantile(s, np.linspace(0, 1, 50)))
    assert np.allclose([r.threshold for r in few], want)
    # NumPy's rank arithmetic can miss a data value by one ulp, ours is exact: compare at ours
    assert [(r.tp, r.fp, r.fn) for r in few] == brute_sweep(y, s, [r.threshold for r in few])


def test_sweep_without_any_hit(spark):
    df = frame(spark, [0, 0, 0], [0.2, 0.4, 0.4])
    assert evaluation.best_threshold(evaluation.threshold_sweep(df)).count() == 0
    assert evaluation.best_threshold(evaluation.threshold_sweep(df), 0.5).first().threshold == 0.5


def test_full_recall_threshold(spark):
    df = frame(spark, [1, 0, 1, 0], [0.9, 0.8, 0.3, 0.1])
    r = evaluation.full_recall_threshold(df).first()
    assert (r.threshold, r.tp, r.fp, r.fn, r.tn) == (0.3, 2, 1, 0, 1)
    assert evaluation.full_recall_threshold(frame(spark, [0], [0.1])).count() == 0


def test_k_above_row_count_is_left_out(spark):
    df = frame(spark, [1] + [0] * 19, [i / 20 for i in range(20)])
    assert [r.k for r in evaluation.precision_at_k(df).collect()] == [10]


def test_average_precision(spark):
    y, s = [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1]
    r = evaluation.pr_summary(frame(spark, y, s)).first()
    assert np.isclose(r.average_precision, 0.5 * 1 + 0.5 * 2 / 3)


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    df = frame(spark, [0, 0, 0], [0.0, 0.5, 1.0])
    assert sorted(r.bin for r in evaluation.score_histogram(df).collect()) == [0, 25, 49]


def test_flags_at_a_tied_threshold(spark):
    from dayglass.detectors.thresholds import flag_above_quantile

    df = frame(spark, [0] * 20, [0.1] * 15 + [0.9] * 5).drop("prediction")
    assert flag_above_quantile(df, 0.95).where("prediction = 1").count() == 0


def test_config_weights():
    assert abs(sum(config.EnsembleParams().weights.values()) - 1) < 1e-9


def test_joins_without_broadcast_give_the_same(spark):
    """A hot user under shuffled joins: same rows, same labels."""
    from dayglass.operators import enrich

    base = T(2024, 1, 1)
    rows = [("hot" if i % 3 else f"u{i}", base + dt.timedelta(hours=i), "a", "p", "r1") for i in range(600)]
    log = spark.createDataFrame(rows, LOG)
    win = spark.createDataFrame([("hot", "r1", base, base + dt.timedelta(days=9))], "user_id string, dataset string, start timestamp_ntz, end timestamp_ntz")
    roles = spark.createDataFrame([("hot", "x"), ("u3", "y")], "user_id string, role string")

    def run():
        found = labelling.label_by_windows(enrich.join_attributes(log, roles), win)
        return sorted((r.user_id, r.date, r.role or "", r.is_insider) for r in found.collect())

    small = run()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == small and len(small) == 600
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_moments_merge(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v) + 1e6, None if v < 0 else float(v)) for g, v in zip(rng.integers(0, 5, 600), rng.normal(size=600))]
    schema = "g int, a double, b double"
    df = spark.createDataFrame(rows, schema)
    whole = moments.moments(df, ["g"], ["a", "b"])
    parts = [moments.moments(spark.createDataFrame(rows[i::4], schema).where("g < 4 or a > 0"), ["g"], ["a", "b"]) for i in range(4)]
    merged = {r.g: r for r in moments.merge_moments(parts, ["g"]).collect()}
    for r in whole.collect():
        for m in ("a", "b"):
            x = np.array([v[1 if m == "a" else 2] for v in rows if v[0] == r.g and v[1 if m == "a" else 2] is not None])
            for got in (r[m], merged[r.g][m]):
                assert got.n == len(x) and np.isclose(got["mean"], x.mean(), rtol=1e-14)
                assert np.isclose(got.m2, ((x - x.mean()) ** 2).sum(), rtol=1e-9)


def test_peer_zscores_from_stored_moments(spark):
    """A new day is scored from its own moments and appended to the others."""
    rows = [(d, f"u{i}", "r" + str(i % 2), float(i * d % 7)) for d in (1, 2, 3) for i in range(8)]
    daily = spark.createDataFrame(rows, "date int, user_id string, role string, m double")
    old, new = daily.where("date < 3"), daily.where("date = 3")
    stats = moments.merge_moments([moments.moments(p, ["role", "date"], ["m"]) for p in (old, new)], ["role", "date"])
    want = {(r.date, r.user_id): r.m_zscore_peer for r in windows.peer_zscores(daily, ["m"]).collect()}
    got = {(r.date, r.user_id): r.m_zscore_peer for r in windows.peer_zscores(daily, ["m"], stats=stats).collect()}
    assert want.keys() == got.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_modes_of_many_columns_in_one_pass(spark):
    rows = [(1, "b", None, 2.5, True), (1, "a", None, 2.5, None), (2, "b", None, 1.5, False), (2, "a", None, None, False)]
    df = spark.createDataFrame(rows, "i int, s string, n int, d double, f boolean")
    modes = cleaning.modes_of(df, df.columns)
    assert modes.first().asDict() == {"i": 1, "s": "a", "n": None, "d": 2.5, "f": False}
    filled = cleaning.fill_missing(df, "fill_mode")
    assert filled.dtypes == df.dtypes and [r.d for r in filled.where("i = 2 and s = 'a'").collect()] == [2.5]
    plan = modes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    medians = cleaning.fill_missing(df, "fill_median", ["i", "d", "n"]).where("s = 'a' and i = 2").first()
    assert medians.d == 2.5 and medians.n is None


def test_category_dictionary_and_index(spark):
    rows = [(i, None if i % 10 == 0 else f"c{i % 137:03d}") for i in range(2_000)]
    df = spark.createDataFrame(rows, "k int, c string")
    dictionary = cleaning.category_dictionary(df, "c")
    names = sorted({c for _, c in rows if c})
    assert {r["category"]: r["index"] for r in dictionary.collect()} == {c: i for i, c in enumerate(names)}
    more = df.unionByName(spark.createDataFrame([(9999, "unseen")], df.schema))
    got = {r.k: r.c_index for r in cleaning.category_index(more, "c", dictionary).collect()}
    assert got == {**{k: names.index(c) if c else len(names) for k, c in rows}, 9999: len(names)}
    with pytest.raises(ValueError, match="more than 100"):
        cleaning.categories_of(df, "c", limit=100)


def test_header_sniff_reads_first_bytes_only(spark, tmp_path):
    import gzip

    from dayglass.sources import logs

    def folder(name, *firsts):
        (tmp_path / name).mkdir()
        for i, first in enumerate(firsts):
            (tmp_path / name / f"part {i}.csv").write_text(first + "x,y\n" * 50_000)
        (tmp_path / name / "empty.csv").write_text("")
        return str(tmp_path / name)

    spark.sparkContext.setJobGroup("sniff", "no job may run")
    assert logs.has_header(spark, folder("with", "id,date\n", "id,date\n"))
    assert not logs.has_header(spark, folder("without", "{a},1\n", " {b},2\n"))
    with pytest.raises(ValueError, match="mixes"):
        logs.has_header(spark, folder("mixed", "id,date\n", "{b},2\n"))
    with gzip.open(tmp_path / "zipped.csv.gz", "wt") as f:
        f.write("{a},1\n")
    assert not logs.has_header(spark, str(tmp_path / "zipped.csv.gz"))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("sniff")
    spark.sparkContext.setJobGroup("tests", "")


@pytest.mark.parametrize("seed", range(3))
def test_weight_search_matches_every_threshold(spark, seed, monkeypatch):
    """All choices, all distinct scores, few bins and many ties; and rows are not multiplied by choices."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(weight_search, "BINS", [7, 64, 2048][seed])
    n = 700
    y = (rng.random(n) < 0.2).astype(int)
    x = np.clip(rng.normal(0.3, 0.2, (n, 3)) + 0.25 * y[:, None], 0, 1).round(2)
    x[: n // 3] = x[0]  # one cell holds a third
    scores = ["score_a", "score_b", "score_c"]
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "score_a double, score_b double, score_c double, true_label int")
    choices = ensemble.weight_choices(("a", "b", "c"), 10)
    cells = weight_search.score_cells(df.repartition(4), scores)
    assert cells.count() == len(np.unique(x, axis=0))
    got = {r.choice: (r.threshold, r.f1_score) for r in weight_search.best_thresholds(cells, scores, choices).collect()}
    for i, w in enumerate(choices):
        s = 0.0 + x[:, 0] * w[0] + x[:, 1] * w[1] + x[:, 2] * w[2]
        best = max((2 * (y[s >= t]).sum() / (y.sum() + (s >= t).sum()), -t) for t in np.unique(s))
        assert np.isclose(got[i][1], best[0], rtol=1e-12) and got[i][0] == -best[1]


def test_weight_search_without_positives(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0), (0.3, 0.4, 0)], "score_a double, score_b double, true_label int")
    cells = weight_search.score_cells(df, ["score_a", "score_b"])
    got = weight_search.best_thresholds(cells, ["score_a", "score_b"], [(0.5, 0.5), (1.0, 0.0)]).collect()
    assert {r.f1_score for r in got} == {0.0} and len(got) == 2


def test_stored_series_are_as_small_as_the_daily_table(spark, tmp_path):
    from dayglass.sinks import writers

    rng = np.random.default_rng(0)
    rows = [(f"u{u}", d, float(rng.random()), float(rng.random()), int(d == 20)) for u in range(40) for d in range(60)]
    daily = spark.createDataFrame(rows, "user string, day int, a double, b double, is_anomaly int").repartition(3)
    series = windows.user_series(daily, ["a", "b"])
    writers.write_sequences(series.coalesce(1), str(tmp_path / "series"))
    daily.coalesce(1).write.parquet(str(tmp_path / "daily"))
    windows.sequences(daily, ["a", "b"]).coalesce(1).write.parquet(str(tmp_path / "windows"))
    size = {n: sum(f.stat().st_size for f in (tmp_path / n).glob("*.parquet")) for n in ("series", "daily", "windows")}
    assert size["series"] < 1.3 * size["daily"] and size["series"] < size["windows"]
    back = writers.read_sequences(spark, str(tmp_path / "series"), stride=10, label_rule="any").collect()
    want = windows.sequences(daily, ["a", "b"], stride=10, label_rule="any").collect()
    assert sorted(map(str, back)) == sorted(map(str, want)) and len(back) == 40 * 5


def test_self_zscores_day_by_day(spark):
    """Scores of each day from a stored tail are those of the whole history at once."""
    rng = np.random.default_rng(6)
    rows = [(d, f"u{u}", float(rng.integers(0, 50)), float(d * u % 7)) for d in range(12) for u in range(6) if (d + u) % 4]
    schema = "date int, user_id string, m double, k double"
    daily = spark.createDataFrame(rows, schema)
    whole = {(r.date, r.user_id): (r.m_zscore_self, r.k_zscore_self) for r in windows.self_zscores(daily, ["m", "k"], days=5).collect()}
    tail, got = spark.createDataFrame([], schema), {}
    for part in (daily.where("date < 8"), daily.where("date = 8"), daily.where("date in (9, 10)"), daily.where("date = 11")):
        scored, tail = windows.extend_self_zscores(tail, part, ["m", "k"], days=5)
        got |= {(r.date, r.user_id): (r.m_zscore_self, r.k_zscore_self) for r in scored.collect()}
        assert tail.groupBy("user_id").count().agg(F.max("count")).first()[0] <= 4
    assert got.keys() == whole.keys() and all(np.allclose(got[k], whole[k]) for k in whole)
