"""Shared pieces of the SQL counterparts (DuckDB dialect)."""

from __future__ import annotations


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


USER = "'U' || lpad(CAST({} AS VARCHAR), 6, '0')"

ACT = f"""act AS (
  SELECT event_id AS id, ts AS date, {USER.format('user_id')} AS user_id, user_id AS n,
    'PC' || json_extract_string(props, '$.k') AS pc_id,
    CASE event_type WHEN 'signup' THEN 'Logon' WHEN 'error' THEN 'Logoff' WHEN 'purchase' THEN 'Connect'
      WHEN 'view' THEN 'File Open' WHEN 'click' THEN 'http' END AS activity,
    CASE event_type WHEN 'signup' THEN 'logon' WHEN 'error' THEN 'logon' WHEN 'purchase' THEN 'device'
      WHEN 'view' THEN 'file' WHEN 'click' THEN 'http' END AS activity_type,
    'r' || CAST(1 + user_id % 2 AS VARCHAR) AS dataset,
    CAST(trunc(value * 10240) AS BIGINT) AS size
  FROM events)"""

WIN = f"""win AS (
  SELECT {USER.format('c_custkey')} AS user_id, 'r' || CAST(1 + c_custkey % 2 AS VARCHAR) AS dataset,
    w.s AS ws, w.e AS we
  FROM customer, (VALUES (TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-12 23:59:59'),
    (TIMESTAMP '2024-01-12 00:00:00', TIMESTAMP '2024-01-14 12:00:00')) w(s, e)
  WHERE c_custkey % 50 = 7)"""

LAB = f"""{ACT}, {WIN}, lab AS (
  SELECT act.*, CASE WHEN EXISTS (SELECT 1 FROM win WHERE win.user_id = act.user_id
    AND win.dataset = act.dataset AND act.date BETWEEN win.ws AND win.we) THEN 1 ELSE 0 END AS is_insider
  FROM act)"""

DAILY_COLUMNS = """
    count(activity) AS daily_activity_count,
    count(DISTINCT pc_id) + max(CASE WHEN pc_id IS NULL THEN 1 ELSE 0 END) AS unique_pcs,
    CAST(0 AS BIGINT) AS unique_ips,
    min(hour(date)) AS first_activity_hour, max(hour(date)) AS last_activity_hour,
    max(hour(date)) - min(hour(date)) AS work_duration_hours,
    count(*) FILTER (activity = 'Logon') AS logon_count,
    count(*) FILTER (activity = 'Logoff') AS logoff_count,
    count(*) FILTER (activity = 'File Open') AS file_access_count,
    count(*) FILTER (activity = 'Email') AS email_count,
    count(*) FILTER (activity = 'Connect') AS usb_connect_count,
    count(*) FILTER (activity = 'http') AS web_visit_count,
    count(*) FILTER (hour(date) < 7 OR hour(date) > 19) AS after_hours_activity"""

DAILY = f"""{LAB}, daily AS (
  SELECT user_id AS "user", CAST(date AS DATE) AS day, {DAILY_COLUMNS},
    CAST(max(is_insider) AS BIGINT) AS is_anomaly
  FROM lab GROUP BY 1, 2)"""

_STAND_INS = {
    "isolation_forest": "daily_activity_count",
    "deep_clustering": "after_hours_activity",
    "lstm_autoencoder": "unique_pcs",
}

PRED = (
    DAILY
    + ", raw AS ("
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS model, "user", day, CAST(is_anomaly AS INTEGER) AS true_label,
        CAST({c} AS DOUBLE) AS v FROM daily"""
        for m, c in _STAND_INS.items()
    )
    + """), lim AS (SELECT model, min(v) AS lo, max(v) AS hi FROM raw GROUP BY 1),
  scored AS (SELECT raw.model, "user", day, true_label,
    CASE WHEN hi - lo < 1e-10 THEN 0.0 ELSE (v - lo) / (hi - lo) END AS anomaly_score
    FROM raw JOIN lim USING (model)),
  p95 AS (SELECT model, quantile_cont(anomaly_score, 0.95) AS q FROM scored GROUP BY 1),
  pred AS (SELECT scored.model, "user", day, true_label,
    CASE WHEN anomaly_score > q THEN 1 ELSE 0 END AS prediction, anomaly_score
    FROM scored JOIN p95 USING (model))"""
)

# models side by side, in the order of the weights
WIDE = PRED + """, wide AS (
  SELECT "user", day, max(true_label) AS true_label,
    max(anomaly_score) FILTER (model = 'isolation_forest') AS s_if,
    max(anomaly_score) FILTER (model = 'lstm_autoencoder') AS s_seq,
    max(anomaly_score) FILTER (model = 'deep_clustering') AS s_dc,
    max(prediction) FILTER (model = 'isolation_forest') AS p_if,
    max(prediction) FILTER (model = 'lstm_autoencoder') AS p_seq,
    max(prediction) FILTER (model = 'deep_clustering') AS p_dc
  FROM pred GROUP BY 1, 2),
 ens AS (
  SELECT "user", day, true_label, (s_if * 0.3::DOUBLE + s_seq * 0.4::DOUBLE + s_dc * 0.3::DOUBLE) / 1.0::DOUBLE AS score,
    CASE WHEN (s_if * 0.3::DOUBLE + s_seq * 0.4::DOUBLE + s_dc * 0.3::DOUBLE) / 1.0::DOUBLE > 0.7 THEN 1 ELSE 0 END AS flag,
    concat_ws(', ', CASE WHEN p_if = 1 THEN 'isolation_forest' END, CASE WHEN p_seq = 1 THEN 'lstm_autoencoder' END,
      CASE WHEN p_dc = 1 THEN 'deep_clustering' END) AS models,
    p_if + p_seq + p_dc AS agree
  FROM wide)"""

# running counts of distinct scores, descending
STEPS = PRED + """, steps AS (
  SELECT model, anomaly_score AS score, sum(true_label)::DOUBLE AS pos, sum(1 - true_label)::DOUBLE AS neg
  FROM pred GROUP BY 1, 2),
 cum AS (
  SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
    sum(pos) OVER (PARTITION BY model) AS tot_p, sum(neg) OVER (PARTITION BY model) AS tot_n
  FROM steps WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def ratio(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) = 0 THEN 0.0 ELSE CAST({part} AS DOUBLE) / ({whole}) END"


AUC = STEPS + f""", auc AS (
  SELECT model, {ratio('sum(neg * (cp - pos / 2.0))', 'max(tot_p * tot_n)')} AS auc_roc FROM cum GROUP BY 1)"""

CONF = """conf AS (SELECT model, count(*) AS n,
    count(*) FILTER (true_label = 0 AND prediction = 0) AS tn, count(*) FILTER (true_label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (true_label = 1 AND prediction = 0) AS fn, count(*) FILTER (true_label = 1 AND prediction = 1) AS tp
  FROM pred GROUP BY 1)"""

METRICS = f"""{AUC}, {CONF}, met AS (
  SELECT conf.model, {ratio('tp + tn', 'n')} AS accuracy, {ratio('tp', 'tp + fp')} AS "precision",
    {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1_score, auc_roc, tn, fp, fn, tp
  FROM conf JOIN auc ON conf.model = auc.model)"""

# role-aware flags derived from the activity log
FLAGS = f"""{LAB}, flagged AS (
  SELECT lab.id, lab.date, lab.user_id, lab.dataset, lab.activity_type, lab.is_insider,
    coalesce(c_mktsegment, 'UNKNOWN') AS role,
    CAST(activity = 'Logon' AS INTEGER) AS is_logon, CAST(activity = 'Logoff' AS INTEGER) AS is_logoff,
    CAST(activity = 'Connect' AS INTEGER) AS is_connect, 0 AS is_disconnect,
    CAST(size AS DOUBLE) AS email_size_kb, CAST(size % 3 = 0 AS INTEGER) AS has_attachment,
    CAST(size > 1048576 AS INTEGER) AS is_large_email,
    CAST(activity = 'http' AND id % 5 = 0 AS INTEGER) AS is_suspicious_domain,
    CAST(activity = 'File Open' AND id % 4 = 0 AS INTEGER) AS is_sensitive_file
  FROM lab LEFT JOIN customer ON c_custkey = lab.n)"""

ROLE_DAILY = FLAGS + """, rd AS (
  SELECT CAST(date AS DATE) AS date, user_id, dataset, role,
    CAST(sum(is_logon) AS BIGINT) AS is_logon_sum, CAST(sum(is_logoff) AS BIGINT) AS is_logoff_sum,
    CAST(sum(is_connect) AS BIGINT) AS is_connect_sum, CAST(sum(is_disconnect) AS BIGINT) AS is_disconnect_sum,
    sum(email_size_kb) AS email_size_kb_sum, avg(email_size_kb) AS email_size_kb_mean,
    CAST(sum(has_attachment) AS BIGINT) AS has_attachment_sum, CAST(sum(is_large_email) AS BIGINT) AS is_large_email_sum,
    CAST(sum(is_suspicious_domain) AS BIGINT) AS is_suspicious_domain_sum,
    CAST(sum(is_sensitive_file) AS BIGINT) AS is_sensitive_file_sum,
    count(activity_type) AS activity_type_count, CAST(max(is_insider) AS BIGINT) AS is_insider_max
  FROM flagged GROUP BY 1, 2, 3, 4)"""
