"""Queries over profiles, windows, scaling, splits and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass import config
from dayglass.functions import temporal
from dayglass.functions.numeric import guarded_ratio
from dayglass.operators import enrich, moments, ordering, profiles, scaling, splits, windows
from dayglass.plans import stages
from dayglass.plans.oracle_parts import ACT, DAILY, FLAGS, ROLE_DAILY, r
from dayglass.plans.registry import query
from dayglass.session import materialise, scratch_path
from dayglass.sinks import writers
from dayglass.sources import adapter

Spark = SparkSession

MEASURES = tuple(profiles.DAILY_MEASURES)


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for comparison."""
    kinds = dict(df.dtypes)
    return df.select(
        *[F.round(c, digits).alias(c) if kinds[c] == "double" and c not in skip else F.col(c) for c in df.columns]
    )


@query("a1_a2_daily_profile", f"WITH {DAILY} SELECT * FROM daily")
def daily_profile(spark: Spark, sf_dir: str) -> DataFrame:
    """Daily profile with labels, straight from the raw events."""
    return profiles.daily_profile(stages.labelled_log(spark, sf_dir))


@query(
    "a1_count_by_kind",
    f"""WITH {ACT} SELECT user_id AS "user", CAST(date AS DATE) AS day, count(activity_type) AS daily_activity_count,
    count(*) FILTER (activity_type = 'file') AS file_access_count, count(*) FILTER (activity_type = 'http') AS web_visit_count
    FROM act GROUP BY 1, 2""",
)
def daily_by_kind(spark: Spark, sf_dir: str) -> DataFrame:
    """Daily counters looking at the log kind instead of the activity."""
    counters = {**profiles.DAILY_COUNTERS, "file_access_count": ("activity_type", "file"), "web_visit_count": ("activity_type", "http")}
    daily = profiles.daily_profile(adapter.activity_log(spark, sf_dir), count_by="activity_type", counters=counters)
    return daily.select("user", "day", "daily_activity_count", "file_access_count", "web_visit_count")


def flagged_log(spark: Spark, sf_dir: str) -> DataFrame:
    """Labelled log with role and derived flags."""
    lab = enrich.join_attributes(stages.labelled_log(spark, sf_dir), adapter.directory(spark, sf_dir))
    activity = F.col("activity")
    return lab.select(
        "id",
        "date",
        "user_id",
        "dataset",
        "activity_type",
        "is_insider",
        F.coalesce("role", F.lit("UNKNOWN")).alias("role"),
        (activity == "Logon").cast("int").alias("is_logon"),
        (activity == "Logoff").cast("int").alias("is_logoff"),
        (activity == "Connect").cast("int").alias("is_connect"),
        F.lit(0).alias("is_disconnect"),
        F.col("size").cast("double").alias("email_size_kb"),
        (F.col("size") % 3 == 0).cast("int").alias("has_attachment"),
        (F.col("size") > 1048576).cast("int").alias("is_large_email"),
        ((activity == "http") & (F.col("id") % 5 == 0)).cast("int").alias("is_suspicious_domain"),
        ((activity == "File Open") & (F.col("id") % 4 == 0)).cast("int").alias("is_sensitive_file"),
    )


@query(
    "a3_role_daily_profile",
    f"""WITH {ROLE_DAILY} SELECT * REPLACE ({r('email_size_kb_mean')} AS email_size_kb_mean) FROM rd""",
)
def role_daily(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profiles.role_daily_profile(flagged_log(spark, sf_dir)))


_WINDOWED = f"""SELECT user_id AS "user", date_trunc('day', date) AS date, count(activity_type) AS activity_count,
    CAST(max(isodow(date) >= 6) AS INTEGER) AS is_weekend, count(*) FILTER (NOT hour(date) BETWEEN 9 AND 17) AS after_hours_count,
    CAST(sum(is_connect) AS BIGINT) AS device_connects, CAST(sum(has_attachment) AS BIGINT) AS emails_with_attachments,
    {r('sum(email_size_kb)')} AS total_email_size_kb, {r('avg(email_size_kb)')} AS avg_email_size_kb,
    CAST(sum(is_suspicious_domain) AS BIGINT) AS suspicious_http_count, max(is_insider) AS is_insider,
    count(*) FILTER (activity_type = 'logon') AS count_logon, count(*) FILTER (activity_type = 'device') AS count_device,
    count(*) FILTER (activity_type = 'file') AS count_file, count(*) FILTER (activity_type = 'email') AS count_email,
    count(*) FILTER (activity_type = 'http') AS count_http FROM flagged GROUP BY 1, 2"""


@query("a4_windowed_profile", f"WITH {FLAGS} SELECT * REPLACE (CAST(date AS TIMESTAMP) AS date) FROM ({_WINDOWED})")
def windowed(spark: Spark, sf_dir: str) -> DataFrame:
    """Profile per user and one-day window."""
    log = temporal.add_calendar(flagged_log(spark, sf_dir))
    return rounded(profiles.windowed_profile(log))


@query(
    "a4_weekly_window",
    f"""WITH {ACT} SELECT user_id AS "user", CAST(time_bucket(INTERVAL 7 DAY, date, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS date,
    count(activity_type) AS activity_count FROM act GROUP BY 1, 2""",
)
def weekly(spark: Spark, sf_dir: str) -> DataFrame:
    """The same profile over seven-day windows."""
    log = adapter.activity_log(spark, sf_dir)
    return profiles.windowed_profile(log, "7 days").select("user", "date", "activity_count")


@query(
    "a5_kind_counts",
    f"""WITH {ACT} SELECT user_id AS "user", CAST(date AS DATE) AS day, """
    + ", ".join(f"count(*) FILTER (activity_type = '{k}') AS count_{k}" for k in config.LOG_KINDS)
    + " FROM act GROUP BY 1, 2",
)
def kind_counts(spark: Spark, sf_dir: str) -> DataFrame:
    keys = [F.col("user_id").alias("user"), F.to_date("date").alias("day")]
    return profiles.pivot_type_counts(adapter.activity_log(spark, sf_dir), keys)


@query(
    "a6_p18_weekend_profile",
    f"""WITH {FLAGS}, g AS (SELECT user_id AS "user", CAST(date AS DATE) AS date, count(activity_type) AS activity_count,
      CAST(sum(CAST(isodow(date) >= 6 AS INTEGER)) AS BIGINT) AS weekend_activity_count,
      count(*) FILTER (NOT hour(date) BETWEEN 9 AND 17) AS after_hours_count, CAST(sum(is_connect) AS BIGINT) AS device_connects,
      {", ".join(f"count(*) FILTER (activity_type = '{k}') AS count_{k}" for k in config.LOG_KINDS)} FROM flagged GROUP BY 1, 2)
    SELECT *, {r('after_hours_count / (activity_count + 1e-10)')} AS after_hours_ratio,
      {r('weekend_activity_count / (activity_count + 1e-10)')} AS weekend_activity_ratio FROM g""",
)
def weekend(spark: Spark, sf_dir: str) -> DataFrame:
    log = temporal.add_calendar(flagged_log(spark, sf_dir))
    return rounded(profiles.weekend_profile(log))


@query(
    "p18_behaviour_ratios",
    f"""WITH {DAILY} SELECT "user", day, {r('after_hours_activity / (daily_activity_count + 1e-10)')} AS after_hours_ratio FROM daily""",
)
def ratios(spark: Spark, sf_dir: str) -> DataFrame:
    share = guarded_ratio(F.col("after_hours_activity"), F.col("daily_activity_count"))
    return stages.daily(spark, sf_dir).select("user", "day", F.round(share, 6).alias("after_hours_ratio"))


_ALL = profiles.DAILY_MEASURES


@query(
    "a7_static_profile",
    f"""WITH {DAILY} SELECT "user", """
    + ", ".join(
        f"{r(f'avg({m})')} AS {m}_mean, {r(f'coalesce(stddev_samp({m}), 0)')} AS {m}_std" for m in _ALL
    )
    + " FROM daily GROUP BY 1",
)
def static(spark: Spark, sf_dir: str) -> DataFrame:
    return rounded(profiles.static_profile(stages.daily(spark, sf_dir)))


@query(
    "a8_statistics_profile",
    f"""WITH {DAILY} SELECT "user", """
    + ", ".join(
        f"""{r(f'avg({m})')} AS {m}_mean, {r(f'coalesce(stddev_samp({m}), 0)')} AS {m}_std, min({m}) AS {m}_min,
        max({m}) AS {m}_max, {r(f'median({m})')} AS {m}_median, CAST(sum({m}) AS BIGINT) AS {m}_sum"""
        for m in MEASURES
    )
    + " FROM daily GROUP BY 1",
)
def statistics(spark: Spark, sf_dir: str) -> DataFrame:
    daily = stages.daily(spark, sf_dir)
    return rounded(profiles.statistics_profile(daily, measures=list(MEASURES), with_sum=True, fill=True))


ROLE_MEASURES = (
    "is_logon_sum",
    "is_logoff_sum",
    "is_connect_sum",
    "is_disconnect_sum",
    "email_size_kb_sum",
    "email_size_kb_mean",
    "has_attachment_sum",
    "is_large_email_sum",
    "is_suspicious_domain_sum",
    "is_sensitive_file_sum",
    "activity_type_count",
)


def _z(x: str, mean: str, std: str) -> str:
    return f"(({x}) - {mean}) / (coalesce({std}, 0) + 1e-10)"


_SELF = ", ".join(
    f"{_z(m, f'avg({m}) OVER w', f'stddev_samp({m}) OVER w')} AS {m}_zscore_self" for m in ROLE_MEASURES
)
_SELF_SQL = f"""{ROLE_DAILY}, sz AS (SELECT *, {_SELF} FROM rd
   WINDOW w AS (PARTITION BY user_id ORDER BY date, dataset, role ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""
_PEER = ", ".join(f"{_z(m, f'm_{m}', f's_{m}')} AS {m}_zscore_peer" for m in ROLE_MEASURES)
_PEER_SQL = f"""{_SELF_SQL}, ps AS (SELECT role, date, """ + ", ".join(
    f"avg({m}) AS m_{m}, stddev_samp({m}) AS s_{m}" for m in ROLE_MEASURES
) + f""" FROM rd GROUP BY 1, 2), pz AS (SELECT sz.*, {_PEER} FROM sz JOIN ps USING (role, date))"""


@query(
    "w1_self_zscores",
    f"""WITH {_SELF_SQL} SELECT date, user_id, dataset, role, """
    + ", ".join(f"{r(f'{m}_zscore_self', 4)} AS {m}_zscore_self" for m in ROLE_MEASURES)
    + " FROM sz",
)
def self_z(spark: Spark, sf_dir: str) -> DataFrame:
    """Trailing 30-row z-scores of every user, from the raw events."""
    daily = profiles.role_daily_profile(flagged_log(spark, sf_dir))
    scored = windows.self_zscores(daily, list(ROLE_MEASURES))
    kept = ["date", "user_id", "dataset", "role"]
    return rounded(scored.select(*kept, *[f"{m}_zscore_self" for m in ROLE_MEASURES]), 4)


@query(
    "w2_peer_zscores",
    f"""WITH {_PEER_SQL} SELECT date, user_id, dataset, role, """
    + ", ".join(f"{r(f'{m}_zscore_peer', 4)} AS {m}_zscore_peer" for m in ROLE_MEASURES)
    + " FROM pz",
)
def peer_z(spark: Spark, sf_dir: str) -> DataFrame:
    """Z-scores within role and date."""
    daily = materialise(profiles.role_daily_profile(flagged_log(spark, sf_dir)), "role-daily")
    scored = windows.peer_zscores(daily, list(ROLE_MEASURES))
    kept = ["date", "user_id", "dataset", "role"]
    return rounded(scored.select(*kept, *[f"{m}_zscore_peer" for m in ROLE_MEASURES]), 4)


def enriched_daily(spark: Spark, sf_dir: str) -> DataFrame:
    daily = materialise(profiles.role_daily_profile(flagged_log(spark, sf_dir)), "role-daily")
    stats = moments.moments(daily, ["role", "date"], list(ROLE_MEASURES))
    return windows.peer_zscores(windows.self_zscores(daily, list(ROLE_MEASURES)), list(ROLE_MEASURES), stats=stats)


_Z = [f"{m}_zscore_{k}" for k in ("self", "peer") for m in ROLE_MEASURES]
_SUMS = (
    "is_logon_sum", "is_logoff_sum", "is_connect_sum", "is_disconnect_sum", "email_size_kb_sum", "email_size_kb_mean",
    "has_attachment_sum", "is_large_email_sum", "is_suspicious_domain_sum", "is_sensitive_file_sum", "activity_type_count",
)


@query(
    "a9_zscore_profile",
    f"WITH {_PEER_SQL} SELECT user_id, "
    + ", ".join(f"{r(f'max({z})', 3)} AS {z}_max, {r(f'avg({z})', 3)} AS {z}_mean" for z in _Z)
    + ", "
    + ", ".join(f"{r(f'sum({c})', 3)} AS {c}_sum" for c in _SUMS)
    + ", max(is_insider_max) AS is_insider FROM pz GROUP BY 1",
)
def zscore_static(spark: Spark, sf_dir: str) -> DataFrame:
    """Per user: max and mean z-scores, total counts, label."""
    profile = profiles.zscore_profile(enriched_daily(spark, sf_dir))
    return profile.select(
        "user_id",
        *[F.round(F.col(c).cast("double"), 3).alias(c) for c in profile.columns if c not in ("user_id", "is_insider")],
        "is_insider",
    )


@query(
    "w6_spikes",
    f"""WITH {DAILY}, q AS (SELECT "user", quantile_cont(daily_activity_count, 0.9) AS lim FROM daily GROUP BY 1)
    SELECT "user", day, daily_activity_count, {r('lim')} AS spike_threshold,
    CAST(daily_activity_count > lim AS INTEGER) AS is_spike FROM daily JOIN q USING ("user")""",
)
def spikes(spark: Spark, sf_dir: str) -> DataFrame:
    daily = stages.daily(spark, sf_dir).select("user", "day", "daily_activity_count")
    return rounded(windows.mark_spikes(daily, "daily_activity_count"))


# --- sequences: each cell compared by position -----------------------------

_SEQ_FEATURES = MEASURES
_WIDTH = len(_SEQ_FEATURES)


def _seq_sql(stride: int, label: str, length: int = 15) -> str:
    return f"""{DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY day) AS rn FROM daily),
 seq AS (SELECT e."user", e.day AS end_day, e.rn, s.rn - (e.rn - {length}) AS t,
   {", ".join(f"s.{m} AS f{i + 1}" for i, m in enumerate(_SEQ_FEATURES))}, {label} AS y
   FROM n e JOIN n s ON s."user" = e."user" AND s.rn BETWEEN e.rn - {length - 1} AND e.rn
   WHERE e.rn >= {length} AND (e.rn - {length}) % {stride} = 0)"""


_LAST = "CAST(e.is_anomaly AS INTEGER)"
_ANY = 'CAST(max(s.is_anomaly) OVER (PARTITION BY e."user", e.rn) AS INTEGER)'


def _cells(found: DataFrame) -> DataFrame:
    """Windows as one row each with sums that depend on every cell's place."""

    def weighted(i: int):
        return F.aggregate(
            F.transform("seq", lambda row, t: row[i] * (t + 1)), F.lit(0.0), lambda acc, v: acc + v
        )

    return found.select(
        "user", "end_day", "label", F.size("seq").alias("steps"), *[weighted(i).cast("long").alias(f"f{i + 1}") for i in range(_WIDTH)]
    )


def _cells_sql(stride: int, label: str) -> str:
    return f"""WITH {_seq_sql(stride, label)} SELECT "user", end_day, max(y) AS label, CAST(count(*) AS INTEGER) AS steps,
      {", ".join(f"CAST(sum(f{i + 1} * t) AS BIGINT) AS f{i + 1}" for i in range(_WIDTH))} FROM seq GROUP BY 1, 2"""


@query("w3_sequences_last_day", _cells_sql(1, _LAST))
def sequences_last(spark: Spark, sf_dir: str) -> DataFrame:
    """15-day windows, stride 1, label of the last day, from the raw events."""
    daily = profiles.daily_profile(stages.labelled_log(spark, sf_dir))
    return _cells(windows.sequences(daily, list(_SEQ_FEATURES)))


@query("w4_sequences_any_day", _cells_sql(10, _ANY))
def sequences_any(spark: Spark, sf_dir: str) -> DataFrame:
    """15-day windows, stride 10, label of any day."""
    daily = stages.daily(spark, sf_dir)
    return _cells(windows.sequences(daily, list(_SEQ_FEATURES), stride=config.LEGACY_STRIDE, label_rule="any"))


@query("k4_sequence_roundtrip", _cells_sql(1, _LAST))
def sequence_sink(spark: Spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sequences")
    writers.write_sequences(windows.user_series(stages.daily(spark, sf_dir), list(_SEQ_FEATURES)), path)
    return _cells(writers.read_sequences(spark, path))


# --- scaling ----------------------------------------------------------------

_DAILY_KEYS = ["date", "user_id", "dataset", "role", "is_insider_max"]


def _scaled_all(source: str, keys: list[str], columns: list[str]) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in columns)
    cols = ", ".join(f"{r(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END', 3)} AS {c}" for c in columns)
    return f"st AS (SELECT {stats} FROM {source}) SELECT {', '.join(keys)}, {cols} FROM {source}, st"


@query("m1_scaled_enriched_daily", f"WITH {_PEER_SQL}, {_scaled_all('pz', _DAILY_KEYS, [*ROLE_MEASURES, *_Z])}")
def scaled_enriched(spark: Spark, sf_dir: str) -> DataFrame:
    """Role-aware daily rows with both z-scores, scaled by their own parameters."""
    enriched = materialise(enriched_daily(spark, sf_dir), "enriched-daily")
    scaled, _ = scaling.scaled_with_parameters(enriched, _DAILY_KEYS)
    return scaled.select(*_DAILY_KEYS, *[F.round(c, 3).alias(c) for c in [*ROLE_MEASURES, *_Z]])


_STATIC = [f"{z}_{f}" for z in _Z for f in ("max", "mean")] + [f"{c}_sum" for c in _SUMS]


@query(
    "m1_scaled_zscore_static",
    f"WITH {_PEER_SQL}, us AS (SELECT user_id, "
    + ", ".join(f"max({z}) AS {z}_max, avg({z}) AS {z}_mean" for z in _Z)
    + ", "
    + ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}_sum" for c in _SUMS)
    + f", max(is_insider_max) AS is_insider FROM pz GROUP BY 1), {_scaled_all('us', ['user_id', 'is_insider'], _STATIC)}",
)
def scaled_static(spark: Spark, sf_dir: str) -> DataFrame:
    """The static profile of z-scores and totals, scaled by parameters of its own."""
    static = materialise(profiles.zscore_profile(enriched_daily(spark, sf_dir)), "zscore-static")
    scaled, _ = scaling.scaled_with_parameters(static, ["user_id", "is_insider"])
    return scaled.select("user_id", "is_insider", *[F.round(c, 3).alias(c) for c in _STATIC])


_ROLES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_DOMAINS = tuple(f"d{i}" for i in range(5))


@query(
    "a8_full_static_table",
    f"""WITH {DAILY}, stats AS (SELECT "user", """
    + ", ".join(
        f"""avg({m}) AS {m}_mean, coalesce(stddev_samp({m}), 0) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max,
        median({m}) AS {m}_median, sum({m}) AS {m}_sum"""
        for m in MEASURES
    )
    + """, max(is_anomaly) AS is_insider FROM daily GROUP BY 1),
    att AS (SELECT 'U' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS "user", CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS role,
      CASE WHEN c_custkey % 7 <> 0 THEN 'd' || c_nationkey % 5 END AS domain, c_custkey % 10 AS o FROM customer WHERE c_custkey % 4 <> 0)
    SELECT stats."user", """
    + ", ".join(f"{r(f'{m}_{f}')} AS {m}_{f}" for m in MEASURES for f in ("mean", "std", "min", "max", "median", "sum"))
    + ", "
    + ", ".join(f"coalesce(CAST(role = '{v}' AS INTEGER), 0) AS role_{v}" for v in _ROLES)
    + """, CAST(att."user" IS NOT NULL AND role IS NULL AS INTEGER) AS role_nan, """
    + ", ".join(f"coalesce(CAST(domain = '{v}' AS INTEGER), 0) AS domain_{v}" for v in _DOMAINS)
    + """, CAST(att."user" IS NOT NULL AND domain IS NULL AS INTEGER) AS domain_nan, CAST(coalesce(o, 0) AS BIGINT) AS O, is_insider
    FROM stats LEFT JOIN att ON att."user" = stats."user" """,
)
def full_static(spark: Spark, sf_dir: str) -> DataFrame:
    """Statistics, one-hot role and domain, traits and label of every user."""
    key = F.col("c_custkey")
    people = adapter.table(spark, sf_dir, "customer").where(key % 4 != 0)
    attributes = people.select(
        F.concat(F.lit("U"), F.lpad(key.cast("string"), 6, "0")).alias("user"),
        F.when(key % 9 != 0, F.col("c_mktsegment")).alias("role"),
        F.when(key % 7 != 0, F.concat(F.lit("d"), (F.col("c_nationkey") % 5).cast("string"))).alias("domain"),
        (key % 10).cast("long").alias("O"),
    )
    table = profiles.full_static_table(
        stages.daily(spark, sf_dir), attributes, {"role": list(_ROLES), "domain": list(_DOMAINS)}, measures=list(MEASURES)
    )
    statistics = [f"{m}_{f}" for m in MEASURES for f in ("mean", "std", "min", "max", "median", "sum")]
    return table.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c in statistics else c for c in table.columns])


def _scaled_sql(features: tuple[str, ...], digits: int = 6) -> str:
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in features)
    cols = ", ".join(
        f"{r(f'({f} - m_{f}) / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END', digits)} AS {f}" for f in features
    )
    return f"""WITH {DAILY}, st AS (SELECT {stats} FROM daily) SELECT "user", day, {cols} FROM daily, st"""


_SCALED = MEASURES


@query("m1_standard_scaling", _scaled_sql(_SCALED))
def standard_scaling(spark: Spark, sf_dir: str) -> DataFrame:
    """Population-std scaling; the constant feature keeps scale 1."""
    daily = stages.daily(spark, sf_dir).select("user", "day", *_SCALED)
    return rounded(scaling.scale(daily, list(_SCALED)))


@query("m2_scaler_refit", _scaled_sql(_SCALED))
def scaler_refit(spark: Spark, sf_dir: str) -> DataFrame:
    """Stored parameters of other features do not fit, so the scaler is refitted."""
    daily = stages.daily(spark, sf_dir).select("user", "day", *_SCALED)
    static = profiles.static_profile(daily)
    stored = scaling.fit_scaler(static, [c for c in static.columns if c != "user"])
    return rounded(scaling.scale(daily, list(_SCALED), stored))


@query(
    "k7_scaler_parameters",
    f"WITH {DAILY} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {r(f'avg({f})')} AS mean, {r(f'CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END')} AS scale FROM daily"
        for f in _SCALED
    ),
)
def scaler_parameters(spark: Spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "scaler")
    writers.write_params(scaling.fit_scaler(stages.daily(spark, sf_dir), list(_SCALED)), path)
    return rounded(writers.read_params(spark, path))


@query(
    "m3_min_max_scores",
    f"""WITH {DAILY}, b AS (SELECT min(daily_activity_count) AS lo, max(daily_activity_count) AS hi FROM daily)
    SELECT "user", day, {r('CAST(daily_activity_count - lo AS DOUBLE) / (hi - lo)')} AS score, 0.0::DOUBLE AS flat FROM daily, b""",
)
def min_max_scores(spark: Spark, sf_dir: str) -> DataFrame:
    daily = stages.daily(spark, sf_dir).select("user", "day", F.col("daily_activity_count").cast("double").alias("score"), F.col("unique_ips").cast("double").alias("flat"))
    return rounded(scaling.normalise(scaling.normalise(daily, "score"), "flat"))


# --- splits and samples -----------------------------------------------------

_U = """(('0x' || substr(md5('42' || "user" || '|' || CAST(day AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"""


@query(
    "r8_train_val_test_split",
    f"""WITH {DAILY} SELECT "user", day, CASE WHEN {_U} < 0.7 THEN 'train' WHEN {_U} < 0.85 THEN 'val' ELSE 'test' END AS split FROM daily""",
)
def split(spark: Spark, sf_dir: str) -> DataFrame:
    daily = stages.daily(spark, sf_dir).select("user", "day")
    return splits.assign_split(daily, F.concat_ws("|", "user", F.col("day").cast("string")))


@query(
    "r9_train_on_normal_split",
    f"""WITH {DAILY} SELECT 'train' AS part, count(*) AS n FROM daily WHERE is_anomaly = 0 AND {_U} < 0.8
    UNION ALL SELECT 'val', count(*) FROM daily WHERE is_anomaly = 0 AND {_U} >= 0.8 UNION ALL SELECT 'test', count(*) FROM daily""",
)
def normal_split(spark: Spark, sf_dir: str) -> DataFrame:
    daily = stages.daily(spark, sf_dir)
    parts = splits.split_normal(daily, F.concat_ws("|", "user", F.col("day").cast("string")), "is_anomaly")
    return ordering.union_all(
        [p.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n")) for n, p in zip(("train", "val", "test"), parts)]
    )


@query(
    "r10_cap_rows",
    f"""WITH {DAILY} SELECT "user", day FROM daily ORDER BY {_U}, "user" || '|' || CAST(day AS VARCHAR) LIMIT 500""",
)
def cap_rows(spark: Spark, sf_dir: str) -> DataFrame:
    """500 rows in hash order: the sampling operator itself, over all rows."""
    daily = stages.daily(spark, sf_dir).select("user", "day")
    return splits.cap_rows(daily, F.concat_ws("|", "user", F.col("day").cast("string")), 500)


@query(
    "r10_sample_normals",
    f"""WITH {DAILY} (SELECT "user", day, is_anomaly FROM daily WHERE is_anomaly = 0
      ORDER BY {_U}, "user" || '|' || CAST(day AS VARCHAR) LIMIT 300)
    UNION ALL SELECT "user", day, is_anomaly FROM daily WHERE is_anomaly > 0""",
)
def sample_normals(spark: Spark, sf_dir: str) -> DataFrame:
    daily = stages.daily(spark, sf_dir).select("user", "day", "is_anomaly")
    return splits.sample_normals(daily, F.concat_ws("|", "user", F.col("day").cast("string")), "is_anomaly", 300)
