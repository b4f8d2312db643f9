"""Queries over sources, sinks, expressions, cleaning and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.functions import numeric, temporal, text
from dayglass.operators import cleaning, enrich, labelling, ordering, profiles
from dayglass.plans import stages
from dayglass.plans.oracle_parts import ACT, DAILY, LAB, PRED, USER, WIN, r
from dayglass.plans.registry import query
from dayglass.session import scratch_path
from dayglass.sinks import writers
from dayglass.sources import adapter, dimensions, logs, tables

Spark = SparkSession


def _text_date(ts: str = "date"):
    return F.date_format(F.col(ts), "MM/dd/yyyy HH:mm:ss")


# --- sources ----------------------------------------------------------------


@query(
    "s1_csv_scan_bad_cells",
    f"""WITH {ACT} SELECT id, user_id, CASE WHEN id % 10 = 0 THEN NULL ELSE size END AS size,
    CAST(date_trunc('second', date) AS TIMESTAMP) AS date FROM act""",
)
def csv_scan(spark: Spark, sf_dir: str) -> DataFrame:
    """Mail log written with unreadable sizes, read back with those cells null."""
    act = adapter.activity_log(spark, sf_dir)
    path = scratch_path(spark, "email.csv")
    size = F.when(F.col("id") % 10 == 0, F.lit("n/a")).otherwise(F.col("size").cast("string"))
    writers.write_csv(act.select("id", _text_date().alias("date"), F.col("user_id").alias("from"), size.alias("size")), path)
    df = logs.standardise(logs.read_log_csv(spark, path, "email"), "email", "r1")
    return df.select(F.col("id").cast("long").alias("id"), "user_id", "size", "date")


@query(
    "s2_headerless_scan",
    f"""WITH {ACT} SELECT '{{' || CAST(id AS VARCHAR) || '}}' AS id, CAST(date_trunc('second', date) AS TIMESTAMP) AS date, user_id, pc_id, activity, activity_type
    FROM act WHERE activity_type = 'logon'""",
)
def headerless_scan(spark: Spark, sf_dir: str) -> DataFrame:
    """Header-less logon log recognised by its first line."""
    act = adapter.activity_log(spark, sf_dir).where(F.col("activity_type") == "logon")
    path = scratch_path(spark, "logon.csv")
    act.select(
        F.concat(F.lit("{"), F.col("id").cast("string"), F.lit("}")).alias("id"), _text_date().alias("date"), "user_id", "pc_id", "activity"
    ).write.csv(path)
    df = logs.standardise(logs.read_log_csv(spark, path, "logon"), "logon", "r1")
    return df.select("id", "date", "user_id", "pc_id", "activity", "activity_type")


def _raw_logs(spark: Spark, sf_dir: str) -> str:
    """The activity log as raw CSV folders ``<dataset>/<kind>.csv``; returns their root."""
    act = adapter.activity_log(spark, sf_dir).withColumns(
        {"date": _text_date(), "user": F.col("user_id"), "pc": F.col("pc_id")}
    )
    root = scratch_path(spark, "raw")
    columns = {
        "logon": ["id", "date", "user", "pc", "activity"],
        "device": ["id", "date", "user", "pc", "activity"],
        "file": ["id", "date", "user", "pc", "filename"],
        "http": ["id", "date", "user", "pc", "url"],
    }
    ext = F.element_at(F.array(*[F.lit(e) for e in ("DOC", "pdf", "exe", "zip", "png")]), (F.col("id") % 5 + 1).cast("int"))
    full = act.withColumns(
        {
            "filename": F.concat(F.lit("/f/"), F.col("id").cast("string"), F.lit("."), ext),
            "url": F.concat(F.lit("http://host"), (F.col("id") % 7).cast("string"), F.lit(".example/"), F.col("id").cast("string")),
        }
    )
    for dataset in ("r1", "r2"):
        for kind, wanted in columns.items():
            part = full.where((F.col("dataset") == dataset) & (F.col("activity_type") == kind))
            writers.write_csv(part.select(*wanted), f"{root}/{dataset}/{kind}.csv")
    return root


@query(
    "s3_dataset_discovery",
    f"""WITH {ACT} SELECT dataset, activity_type, count(*) AS n, count(DISTINCT user_id) AS users,
    CAST(date_trunc('second', min(date)) AS TIMESTAMP) AS first_date, CAST(sum(CASE WHEN activity = 'Logon' THEN 1 ELSE 0 END) AS BIGINT) AS logons,
    CAST(sum(CASE WHEN activity_type = 'file' AND id % 5 IN (0, 1, 3) THEN 1 ELSE 0 END) AS BIGINT) AS sensitive
    FROM act GROUP BY 1, 2""",
)
def dataset_discovery(spark: Spark, sf_dir: str) -> DataFrame:
    """All logs of all dataset folders, tagged with dataset and kind."""
    df = logs.read_logs(spark, _raw_logs(spark, sf_dir), subset=None)
    return df.groupBy("dataset", "activity_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("user_id").alias("users"),
        F.min("date").alias("first_date"),
        F.coalesce(F.sum("is_logon"), F.lit(0)).cast("long").alias("logons"),
        F.coalesce(F.sum("is_sensitive_file"), F.lit(0)).cast("long").alias("sensitive"),
    )


@query(
    "s3_dataset_from_path",
    f"WITH {ACT} SELECT dataset, count(*) AS n FROM act GROUP BY 1",
)
def dataset_from_path(spark: Spark, sf_dir: str) -> DataFrame:
    """One glob over all datasets, the tag taken from the file path."""
    root = _raw_logs(spark, sf_dir)
    raw = spark.read.option("header", True).csv(f"{root}/*/*.csv")
    return raw.groupBy(logs.dataset_of_path(F.col("_metadata.file_path")).alias("dataset")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "s4_directory_latest_role",
    f"""SELECT {USER.format('c_custkey')} AS user_id,
    CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '2' ELSE c_mktsegment END AS role FROM customer""",
)
def directory_scan(spark: Spark, sf_dir: str) -> DataFrame:
    """Two monthly directory files; even users changed role in the second."""
    people = adapter.directory(spark, sf_dir)
    number = F.substring("user_id", 2, 6).cast("int")
    root = scratch_path(spark, "directory")
    writers.write_csv(people, f"{root}/2024-01.csv")
    changed = people.where(number % 2 == 0).withColumn("role", F.concat("role", F.lit("2")))
    writers.write_csv(changed, f"{root}/2024-02.csv")
    writers.write_csv(people.select("user_id"), f"{root}/2024-03.csv")
    files = [f"{root}/2024-0{m}.csv" for m in (1, 2, 3)]
    return dimensions.read_directory(spark, files)


@query(
    "s5_traits_first",
    f"""SELECT {USER.format('c_custkey')} AS user_id, """
    + ", ".join(f"CAST(c_custkey * {i + 3} % 50 AS INTEGER) AS {c}" for i, c in enumerate("OCEAN"))
    + " FROM customer",
)
def traits_scan(spark: Spark, sf_dir: str) -> DataFrame:
    """Trait files of two datasets; the first one wins."""
    people = adapter.traits(spark, sf_dir)
    root = scratch_path(spark, "traits")
    writers.write_csv(people, f"{root}/r1/psychometric.csv")
    writers.write_csv(people.withColumn("O", F.col("O") + 1), f"{root}/r2/psychometric.csv")
    return dimensions.read_traits(spark, [f"{root}/{d}/psychometric.csv" for d in ("r1", "r2")])


@query(
    "s6_incident_windows",
    f"""WITH {WIN} SELECT user_id, dataset, ws AS start, we AS "end" FROM win WHERE dataset = 'r2'""",
)
def incident_scan(spark: Spark, sf_dir: str) -> DataFrame:
    """Incident file with bare dataset numbers and unreadable dates, one dataset wanted."""
    known = adapter.incidents(spark, sf_dir)
    form = "yyyy-MM-dd HH:mm:ss"
    rows = known.select(
        F.substring("dataset", 2, 9).alias("dataset"),
        F.col("user_id").alias("user"),
        F.date_format("start", form).alias("start"),
        F.date_format("end", form).alias("end"),
    )
    broken = rows.withColumn("start", F.lit("soon"))
    path = scratch_path(spark, "insiders.csv")
    writers.write_csv(rows.unionByName(broken), path)
    return dimensions.read_incidents(spark, path, ["r2"])


@query(
    "s7_unified_scan_csv",
    f"WITH {ACT} SELECT dataset, activity_type, count(*) AS n, max(date) AS last_date FROM act GROUP BY 1, 2",
)
def unified_scan(spark: Spark, sf_dir: str) -> DataFrame:
    """Unified log through CSV, chosen by suffix."""
    act = adapter.activity_log(spark, sf_dir)
    path = f"{scratch_path(spark, 'unified')}.csv"
    writers.write_unified_log(act, path, "csv")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in act.schema.fields)
    df = tables.scan_table(spark, path, schema, ["dataset", "activity_type", "date"])
    return df.groupBy("dataset", "activity_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("date").alias("last_date")
    )


@query("s8_daily_profile_scan", f"WITH {DAILY} SELECT * FROM daily")
def daily_scan(spark: Spark, sf_dir: str) -> DataFrame:
    """Stored daily profile."""
    return stages.daily(spark, sf_dir)


@query(
    "s9_prediction_scan",
    f"""WITH {PRED} SELECT model, "user", day, true_label, prediction, {r('anomaly_score')} AS anomaly_score
    FROM pred WHERE model <> 'lstm_autoencoder'""",
)
def prediction_scan(spark: Spark, sf_dir: str) -> DataFrame:
    """Prediction table with one model folder missing."""
    path = scratch_path(spark, "predictions")
    stored = stages.predictions(spark, sf_dir).where(F.col("model") != "lstm_autoencoder")
    writers.write_predictions(stored, path)
    return tables.read_predictions(spark, path).select(
        "model", "user", "day", "true_label", "prediction", F.round("anomaly_score", 6).alias("anomaly_score")
    )


@query(
    "s10_user_list",
    f"SELECT {USER.format('c_custkey')} AS user_id FROM customer WHERE c_custkey % 3 <> 0",
)
def user_list(spark: Spark, sf_dir: str) -> DataFrame:
    """Text file with padded and blank lines."""
    people = adapter.directory(spark, sf_dir)
    number = F.substring("user_id", 2, 6).cast("int")
    line = F.when(number % 3 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), F.col("user_id"), F.lit(" ")))
    path = scratch_path(spark, "users.txt")
    people.select(line.alias("value")).write.text(path)
    return dimensions.read_user_list(spark, path)


@query(
    "s11_alias_resolution",
    f"""WITH {PRED} SELECT "user" AS user_id, true_label AS label, {r('anomaly_score')} AS score
    FROM pred WHERE model = 'deep_clustering'""",
)
def alias_resolution(spark: Spark, sf_dir: str) -> DataFrame:
    """Predictions under unusual column spellings."""
    raw = stages.predictions(spark, sf_dir).where(F.col("model") == "deep_clustering")
    odd = raw.select(
        F.col("user").alias(" User"), F.col("true_label").alias("Ground_Truth "), F.col("anomaly_score").alias("Reconstruction_Error"), "prediction"
    )
    return tables.resolve_prediction_columns(odd).withColumn("score", F.round("score", 6))


@query("s12_pruned_read", "SELECT user_id, ts, event_type FROM events")
def pruned_read(spark: Spark, sf_dir: str) -> DataFrame:
    """Three columns of a wide table; the scan reads only those."""
    return tables.scan_table(spark, f"{sf_dir.rstrip('/')}/events.parquet", columns=["user_id", "ts", "event_type"])


@query(
    "s13_first_rows",
    "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 1000",
)
def first_rows(spark: Spark, sf_dir: str) -> DataFrame:
    """Quick look: first rows by key."""
    events = adapter.table(spark, sf_dir, "events").select("event_id", "event_type")
    return tables.peek(events, 1000, ["event_id"])


# --- sinks: write, read back, compare --------------------------------------


@query(
    "k1_unified_log_partitioned",
    f"WITH {LAB} SELECT dataset, count(*) AS n, CAST(sum(is_insider) AS BIGINT) AS insiders FROM lab GROUP BY 1",
)
def unified_sink(spark: Spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "unified")
    writers.write_unified_log(stages.labelled_log(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_insider").cast("long").alias("insiders")
    )


@query("k2_profile_roundtrip", f"WITH {DAILY} SELECT * FROM daily")
def profile_sink(spark: Spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "profile")
    writers.write_profile(stages.daily(spark, sf_dir), path)
    return spark.read.parquet(path)


@query(
    "k3_csv_roundtrip",
    f"""WITH {DAILY} SELECT "user", {r('avg(daily_activity_count)')} AS mean_activity FROM daily GROUP BY 1""",
)
def csv_sink(spark: Spark, sf_dir: str) -> DataFrame:
    path = f"{scratch_path(spark, 'static')}.csv"
    static = stages.daily(spark, sf_dir).groupBy("user").agg(F.avg("daily_activity_count").alias("mean_activity"))
    writers.write_csv(static, path)
    back = tables.scan_table(spark, path, "user string, mean_activity double")
    return back.select("user", F.round("mean_activity", 6).alias("mean_activity"))


@query(
    "k5_predictions_partitioned",
    f"""WITH {PRED} SELECT model, count(*) AS n, CAST(sum(prediction) AS BIGINT) AS flagged FROM pred
    WHERE model = 'isolation_forest' GROUP BY 1""",
)
def prediction_sink(spark: Spark, sf_dir: str) -> DataFrame:
    """One model of a partitioned prediction table; the other folders are not read."""
    path = scratch_path(spark, "predictions")
    writers.write_predictions(stages.predictions(spark, sf_dir), path)
    one = tables.read_predictions(spark, path, ["isolation_forest"])
    return one.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("prediction").cast("long").alias("flagged")
    )


@query(
    "k9_json_roundtrip",
    f"WITH {ACT} SELECT activity, count(*) AS n FROM act GROUP BY 1",
)
def json_sink(spark: Spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "summary.json")
    counts = adapter.activity_log(spark, sf_dir).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))
    writers.write_json(counts, path)
    return writers.read_json(spark, path, "activity string, n long")


# --- expressions ------------------------------------------------------------


@query(
    "p1_p2_standard_columns",
    f"""WITH {ACT} SELECT id, user_id, CAST(NULL AS VARCHAR) AS pc_id, 'http' AS activity_type, 'r9' AS dataset FROM act""",
)
def standard_columns(spark: Spark, sf_dir: str) -> DataFrame:
    """``user`` renamed, missing ``pc`` as null, kind and dataset added."""
    raw = adapter.activity_log(spark, sf_dir).select("id", F.col("user_id").alias("user"), "date")
    return logs.standardise(raw, "http", "r9").select("id", "user_id", "pc_id", "activity_type", "dataset")


_DATE_TEXT = """CASE WHEN o_orderkey % 11 = 0 THEN 'n/a'
   WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%d/%Y %H:%M:%S')
   ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END"""


@query(
    "p3_two_format_dates",
    f"""SELECT o_orderkey, CAST(coalesce(try_strptime({_DATE_TEXT}, '%m/%d/%Y %H:%M:%S'),
    try_strptime({_DATE_TEXT}, '%Y-%m-%d %H:%M:%S')) AS TIMESTAMP) AS date FROM orders""",
)
def two_format_dates(spark: Spark, sf_dir: str) -> DataFrame:
    return _dated_orders(spark, sf_dir)


def _dated_orders(spark: Spark, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    shown = (
        F.when(key % 11 == 0, F.lit("n/a"))
        .when(key % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    )
    return adapter.table(spark, sf_dir, "orders").select("o_orderkey", text.parse_activity_time(shown).alias("date"))


@query(
    "p4_drop_unparsed_dates",
    "SELECT o_orderkey, CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) AS date FROM orders WHERE o_orderkey % 11 <> 0",
)
def drop_unparsed(spark: Spark, sf_dir: str) -> DataFrame:
    return cleaning.drop_unparsed_dates(_dated_orders(spark, sf_dir))


@query(
    "p5_p6_activity_flags",
    f"""WITH {ACT} SELECT id, CAST(activity = 'Logon' AS BIGINT) AS is_logon, CAST(activity = 'Logoff' AS BIGINT) AS is_logoff,
    CAST(activity = 'Connect' AS BIGINT) AS is_connect, CAST(activity = 'Disconnect' AS BIGINT) AS is_disconnect FROM act""",
)
def activity_flags(spark: Spark, sf_dir: str) -> DataFrame:
    act = adapter.activity_log(spark, sf_dir)
    flags = logs.kind_columns(act, "logon") | logs.kind_columns(act, "device")
    return act.select("id", *[c.cast("long").alias(n) for n, c in flags.items()])


@query(
    "p7_email_columns",
    f"""WITH {ACT} SELECT id, {r('size / 1024.0', 4)} AS email_size_kb, CAST(size > 1048576 AS BIGINT) AS is_large_email,
    CAST(id % 4 <> 0 AS BIGINT) AS has_attachment FROM act""",
)
def email_columns(spark: Spark, sf_dir: str) -> DataFrame:
    act = adapter.activity_log(spark, sf_dir).withColumn("attachments", F.when(F.col("id") % 4 != 0, F.lit("a.doc")))
    out = logs.kind_columns(act, "email")
    return act.select(
        "id",
        F.round(out["email_size_kb"], 4).alias("email_size_kb"),
        out["is_large_email"].cast("long").alias("is_large_email"),
        out["has_attachment"].cast("long").alias("has_attachment"),
    )


@query(
    "p8_p9_hosts",
    r"""SELECT page_id, nullif(regexp_extract(url, 'https?://([^/]+)', 1), '') AS host,
    CAST(regexp_matches(lower(nullif(regexp_extract(url, 'https?://([^/]+)', 1), '')), 'example|1|news') AS BIGINT) AS is_suspicious
    FROM pages""",
)
def hosts(spark: Spark, sf_dir: str) -> DataFrame:
    """Host of every page and a keyword flag with words that occur in the data."""
    host = text.url_host(F.col("url"))
    words = ("example", "1", "news")
    return adapter.table(spark, sf_dir, "pages").select(
        "page_id", host.alias("host"), text.is_suspicious_host(host, words).cast("long").alias("is_suspicious")
    )


_FILENAME = """CASE WHEN p_partkey % 7 = 0 THEN 'README' || CAST(p_partkey AS VARCHAR) ELSE
  '/f/' || CAST(p_partkey AS VARCHAR) || '.' || ['DOC', 'pdf', 'exe', 'zip', 'png'][p_partkey % 5 + 1] END"""


@query(
    "p10_p11_file_extensions",
    f"""SELECT p_partkey, lower(string_split({_FILENAME}, '.')[-1]) AS file_extension,
    CAST(lower(string_split({_FILENAME}, '.')[-1]) IN ('doc','docx','xls','xlsx','pdf','txt','sql','db','zip','rar') AS BIGINT)
      AS is_sensitive_file FROM part""",
)
def file_extensions(spark: Spark, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("DOC", "pdf", "exe", "zip", "png")]), (key % 5 + 1).cast("int"))
    name = F.when(key % 7 == 0, F.concat(F.lit("README"), key.cast("string"))).otherwise(
        F.concat(F.lit("/f/"), key.cast("string"), F.lit("."), ext)
    )
    found = text.file_extension(name)
    return adapter.table(spark, sf_dir, "part").select(
        "p_partkey", found.alias("file_extension"), text.is_sensitive_extension(found).cast("long").alias("is_sensitive_file")
    )


@query(
    "p12_default_fill",
    f"""WITH {ACT} SELECT id, CASE WHEN c_custkey % 4 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END AS role, 0 AS "O", 0 AS N,
    CASE WHEN activity_type = 'logon' THEN CAST(activity = 'Logon' AS INTEGER) ELSE 0 END AS is_logon
    FROM act JOIN customer ON c_custkey = n""",
)
def default_fill(spark: Spark, sf_dir: str) -> DataFrame:
    act = adapter.activity_log(spark, sf_dir)
    number = F.substring("user_id", 2, 6).cast("int")
    people = adapter.directory(spark, sf_dir).where(number % 4 != 0)
    flagged = act.withColumn("is_logon", F.when(F.col("activity_type") == "logon", (F.col("activity") == "Logon").cast("byte")))
    filled = cleaning.fill_log_defaults(enrich.join_attributes(flagged, people))
    return filled.select("id", "role", "O", "N", F.col("is_logon").cast("int").alias("is_logon"))


@query(
    "p13_fill_by_type",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'UNKNOWN' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS price FROM orders""",
)
def type_fill(spark: Spark, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    holes = adapter.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 5 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(key % 3 != 0, F.col("o_totalprice")).alias("price"),
    )
    return cleaning.fill_by_type(holes)


@query(
    "p14_column_alignment",
    f"""WITH {ACT} SELECT id, user_id, CAST(NULL AS VARCHAR) AS url, CAST(0 AS DOUBLE) AS email_size_kb, activity FROM act""",
)
def column_alignment(spark: Spark, sf_dir: str) -> DataFrame:
    act = adapter.activity_log(spark, sf_dir).select("activity", "user_id", "id")
    layout = {"id": "long", "user_id": "string", "url": "string", "email_size_kb": "double"}
    return cleaning.align_columns(act, layout, {"email_size_kb": 0.0})


@query(
    "p15_p16_calendar",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
    CAST(day(ts) AS INTEGER) AS day_of_month, CAST(month(ts) AS INTEGER) AS month,
    CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, CAST(hour(ts) BETWEEN 9 AND 17 AS INTEGER) AS is_business_hours,
    CAST(hour(ts) >= 22 OR hour(ts) <= 6 AS INTEGER) AS is_night_shift,
    CAST(hour(ts) BETWEEN 0 AND 6 AS INTEGER) AS is_early_morning, CAST(hour(ts) BETWEEN 20 AND 23 AS INTEGER) AS is_late_night
    FROM events""",
)
def calendar(spark: Spark, sf_dir: str) -> DataFrame:
    events = adapter.table(spark, sf_dir, "events").select("event_id", "ts")
    return temporal.add_calendar(events, "ts", shifts=True).drop("ts")


_PSEUDO = "'USER_' || substr(sha256('salty_salty_salt' || {}), 1, 12)"


@query(
    "p17_pseudonyms",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'UNKNOWN' ELSE {_PSEUDO.format('c_name')} END AS name_pseudo
    FROM customer""",
)
def pseudonyms(spark: Spark, sf_dir: str) -> DataFrame:
    people = adapter.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 13 != 0, F.col("c_name")).alias("name")
    )
    return cleaning.add_pseudonym(people, "name").drop("name")


@query(
    "p19_binary_labels",
    """SELECT o_orderkey, CASE WHEN coalesce(TRY_CAST(CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN '0'
    WHEN 3 THEN '1' WHEN 4 THEN '3' ELSE '-2' END AS DOUBLE), 0) > 0 THEN 1 ELSE 0 END AS label FROM orders""",
)
def binary_labels(spark: Spark, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 6
    shown = F.when(key == 1, "x").when(key == 2, "0").when(key == 3, "1").when(key == 4, "3").when(key == 5, "-2")
    return adapter.table(spark, sf_dir, "orders").select("o_orderkey", numeric.binary_label(shown).alias("label"))


_RAW_ID = "CASE o_orderkey % 4 WHEN 0 THEN '2.0' WHEN 1 THEN '3.1-1' WHEN 2 THEN '3.1-2' ELSE '4.2' END"


@query(
    "p20_p21_dataset_ids",
    f"""SELECT {_RAW_ID} AS raw_id, 'r' || replace(split_part({_RAW_ID}, '-', 1), '.0', '') AS dataset,
    'r' || regexp_replace({_RAW_ID}, '^r', '') AS prefixed, count(*) AS n FROM orders GROUP BY 1, 2, 3""",
)
def dataset_ids(spark: Spark, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 4
    raw = F.when(key == 0, "2.0").when(key == 1, "3.1-1").when(key == 2, "3.1-2").otherwise("4.2")
    rows = adapter.table(spark, sf_dir, "orders").select(raw.alias("raw_id"))
    named = rows.select(
        "raw_id", text.normal_dataset_id(F.col("raw_id")).alias("dataset"), text.prefixed_dataset_id(F.col("raw_id")).alias("prefixed")
    )
    return named.groupBy("raw_id", "dataset", "prefixed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p22_p23_finite_and_threshold",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS x, CAST(value > 50.0 AS INTEGER) AS above,
    CAST(value >= 50.0 AS INTEGER) AS at_least FROM events""",
)
def finite_and_threshold(spark: Spark, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return adapter.table(spark, sf_dir, "events").select(
        "event_id",
        numeric.finite_or_zero(broken).alias("x"),
        numeric.above(F.col("value"), 50.0).alias("above"),
        numeric.above(F.col("value"), 50.0, inclusive=True).alias("at_least"),
    )


@query(
    "p24_display_names",
    f"""WITH {PRED} SELECT CASE model WHEN 'isolation_forest' THEN 'Isolation Forest' WHEN 'deep_clustering' THEN 'Deep Clustering'
    ELSE 'Lstm Autoencoder' END AS model, {r('avg(anomaly_score)', 4)} AS mean_score FROM pred GROUP BY 1""",
)
def display_names(spark: Spark, sf_dir: str) -> DataFrame:
    return stages.predictions(spark, sf_dir).groupBy(text.display_name(F.col("model")).alias("model")).agg(
        F.round(F.avg("anomaly_score"), 4).alias("mean_score")
    )


@query(
    "p25_day_from_index",
    """SELECT o_orderkey, CAST(DATE '2024-01-01' + CAST(o_orderkey % 400 AS INTEGER) AS DATE) AS day FROM orders""",
)
def day_index(spark: Spark, sf_dir: str) -> DataFrame:
    return adapter.table(spark, sf_dir, "orders").select(
        "o_orderkey", temporal.day_from_index(F.col("o_orderkey") % 400).alias("day")
    )


@query(
    "p26_one_hot",
    """SELECT c_custkey, """
    + ", ".join(
        f"CAST(c_custkey % 9 <> 0 AND c_mktsegment = '{s}' AS INTEGER) AS \"role_{s}\""
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + ", CAST(c_custkey % 9 = 0 AS INTEGER) AS role_nan FROM customer",
)
def one_hot(spark: Spark, sf_dir: str) -> DataFrame:
    people = adapter.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("role")
    )
    return cleaning.one_hot(people, "role", cleaning.categories_of(people, "role"))


@query(
    "p26_category_index",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey || '-' || c_mktsegment END AS role FROM customer),
    d AS (SELECT role, row_number() OVER (ORDER BY role) - 1 AS i FROM (SELECT DISTINCT role FROM c WHERE role IS NOT NULL))
    SELECT c_custkey, coalesce(i, (SELECT count(*) FROM d)) AS role_index FROM c LEFT JOIN d USING (role)""",
)
def category_index(spark: Spark, sf_dir: str) -> DataFrame:
    """Sparse form of the one-hot columns: the place of the 1."""
    name = F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment")
    people = adapter.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 9 != 0, name).alias("role")
    )
    return cleaning.category_index(people, "role", cleaning.category_dictionary(people, "role"))


@query(
    "p27_mean_absolute",
    f"""WITH {DAILY} SELECT "user", day, {r('(abs(daily_activity_count - 3) + abs(unique_pcs - 5) + abs(logon_count)) / 3.0')}
    AS mean_abs FROM daily""",
)
def mean_absolute(spark: Spark, sf_dir: str) -> DataFrame:
    columns = [F.col("daily_activity_count") - 3, F.col("unique_pcs") - 5, F.col("logon_count")]
    return stages.daily(spark, sf_dir).select("user", "day", F.round(numeric.mean_abs(columns), 6).alias("mean_abs"))


# --- cleaning ---------------------------------------------------------------


@query(
    "a11_distinct_rows",
    "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
)
def distinct_rows(spark: Spark, sf_dir: str) -> DataFrame:
    rows = adapter.table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    return cleaning.drop_duplicate_rows(rows.unionByName(rows))


@query(
    "a11_null_counts",
    f"""SELECT CAST(count(*) FILTER (o_orderkey % 11 = 0) AS BIGINT) AS date, CAST(0 AS BIGINT) AS o_orderkey FROM orders""",
)
def null_counts(spark: Spark, sf_dir: str) -> DataFrame:
    return cleaning.null_counts(_dated_orders(spark, sf_dir))


@query(
    "a12_keep_first_last",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders)
    SELECT o_custkey, max(o_orderkey) FILTER (a = 1) AS first_order, max(o_orderkey) FILTER (z = 1) AS last_order
    FROM f GROUP BY 1""",
)
def keep_first_last(spark: Spark, sf_dir: str) -> DataFrame:
    orders = adapter.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    first = cleaning.keep_one(orders, ["o_custkey"], order, "first").select("o_custkey", F.col("o_orderkey").alias("first_order"))
    last = cleaning.keep_one(orders, ["o_custkey"], order, "last").select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return first.join(last, "o_custkey")


_HOLES = """h AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS value,
   CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type FROM events)"""


def _holes(spark: Spark, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return adapter.table(spark, sf_dir, "events").select(
        "event_id", F.when(key % 6 != 0, F.col("value")).alias("value"), F.when(key % 7 != 0, F.col("event_type")).alias("event_type")
    )


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


@query(
    "a13_missing_drop",
    f"WITH {_HOLES} SELECT event_id, {r('value')} AS value, event_type FROM h WHERE value IS NOT NULL AND event_type IS NOT NULL",
)
def missing_drop(spark: Spark, sf_dir: str) -> DataFrame:
    return _shown(cleaning.fill_missing(_holes(spark, sf_dir), "drop"))


@query(
    "a13_missing_mean",
    f"WITH {_HOLES} SELECT event_id, {r('coalesce(value, (SELECT avg(value) FROM h))')} AS value, event_type FROM h",
)
def missing_mean(spark: Spark, sf_dir: str) -> DataFrame:
    return _shown(cleaning.fill_missing(_holes(spark, sf_dir), "fill_mean", ["value"]))


@query(
    "a13_missing_median",
    f"WITH {_HOLES} SELECT event_id, {r('coalesce(value, (SELECT quantile_cont(value, 0.5) FROM h))')} AS value, event_type FROM h",
)
def missing_median(spark: Spark, sf_dir: str) -> DataFrame:
    return _shown(cleaning.fill_missing(_holes(spark, sf_dir), "fill_median", ["value"]))


@query(
    "a13_missing_mode",
    f"""WITH {_HOLES}, mv AS (SELECT value FROM h WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, value LIMIT 1),
    mt AS (SELECT event_type FROM h WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)
    SELECT event_id, {r('coalesce(value, (SELECT value FROM mv))')} AS value,
    coalesce(event_type, (SELECT event_type FROM mt)) AS event_type FROM h""",
)
def missing_mode(spark: Spark, sf_dir: str) -> DataFrame:
    return _shown(cleaning.fill_missing(_holes(spark, sf_dir), "fill_mode"))


# --- joins and labels -------------------------------------------------------


@query(
    "j1_directory_join",
    f"WITH {ACT} SELECT id, user_id, c_mktsegment AS role FROM act LEFT JOIN customer ON c_custkey = n AND c_custkey % 4 <> 0",
)
def directory_join(spark: Spark, sf_dir: str) -> DataFrame:
    number = F.substring("user_id", 2, 6).cast("int")
    people = adapter.directory(spark, sf_dir).where(number % 4 != 0)
    act = adapter.activity_log(spark, sf_dir).select("id", "user_id")
    return enrich.join_attributes(act, people).select("id", "user_id", "role")


@query(
    "j2_trait_join",
    f"""WITH {ACT} SELECT id, user_id, CAST(c_custkey * 3 % 50 AS INTEGER) AS "O", CAST(c_custkey * 7 % 50 AS INTEGER) AS N
    FROM act LEFT JOIN customer ON c_custkey = n""",
)
def trait_join(spark: Spark, sf_dir: str) -> DataFrame:
    act = adapter.activity_log(spark, sf_dir).select("id", "user_id")
    return enrich.join_traits(act, adapter.traits(spark, sf_dir).select("user_id", "O", "N"))


@query("j3_j4_interval_label", f"WITH {LAB} SELECT id, user_id, dataset, date, is_insider FROM lab")
def interval_label(spark: Spark, sf_dir: str) -> DataFrame:
    """Interval labelling keyed by user and dataset."""
    return stages.labelled_log(spark, sf_dir).select("id", "user_id", "dataset", "date", "is_insider")


@query(
    "j3_interval_label_by_user",
    f"""WITH {ACT}, {WIN} SELECT id, user_id, CASE WHEN EXISTS (SELECT 1 FROM win WHERE win.user_id = act.user_id
    AND act.date BETWEEN win.ws AND win.we) THEN 1 ELSE 0 END AS is_insider FROM act""",
)
def interval_label_by_user(spark: Spark, sf_dir: str) -> DataFrame:
    """Interval labelling that ignores the dataset."""
    act = adapter.activity_log(spark, sf_dir).select("id", "user_id", "date")
    return labelling.label_by_windows(act, adapter.incidents(spark, sf_dir), ("user_id",)).drop("date")


@query(
    "j5_pseudonym_label",
    f"""WITH {LAB} SELECT id, {_PSEUDO.format('user_id')} AS user_pseudo, is_insider FROM lab""",
)
def pseudonym_label(spark: Spark, sf_dir: str) -> DataFrame:
    act = adapter.activity_log(spark, sf_dir).select("id", "date", text.pseudonym(F.col("user_id")).alias("user_pseudo"))
    return labelling.label_pseudonyms(act, adapter.incidents(spark, sf_dir)).drop("date")


@query(
    "j6_member_label",
    f"""WITH {ACT}, {WIN} SELECT id, user_id, CASE WHEN user_id IN (SELECT user_id FROM win) THEN 1 ELSE 0 END AS is_insider FROM act""",
)
def member_label(spark: Spark, sf_dir: str) -> DataFrame:
    act = adapter.activity_log(spark, sf_dir).select("id", "user_id")
    return labelling.label_by_members(act, adapter.incidents(spark, sf_dir))


@query(
    "j7_daily_label_join",
    f"""WITH {DAILY} SELECT "user", day, daily_activity_count, is_anomaly FROM daily""",
)
def daily_label_join(spark: Spark, sf_dir: str) -> DataFrame:
    """Daily features with separately grouped positive days, absent ones 0."""
    daily = stages.daily(spark, sf_dir)
    labels = daily.where(F.col("is_anomaly") > 0).select("user", "day", "is_anomaly")
    return enrich.join_labels(daily.select("user", "day", "daily_activity_count"), labels, ["user", "day"], "is_anomaly")


@query(
    "j8_static_label_join",
    f"""WITH {DAILY}, s AS (SELECT "user", {r('avg(daily_activity_count)')} AS mean_activity, max(is_anomaly) AS is_anomaly
     FROM daily GROUP BY 1) SELECT s.*, c_mktsegment AS role FROM s JOIN customer ON "user" = {USER.format('c_custkey')}""",
)
def static_label_join(spark: Spark, sf_dir: str) -> DataFrame:
    from dayglass.operators.profiles import user_labels

    daily = stages.daily(spark, sf_dir)
    static = daily.groupBy("user").agg(F.round(F.avg("daily_activity_count"), 6).alias("mean_activity"))
    labelled = enrich.join_labels(static, user_labels(daily), ["user"], "is_anomaly")
    people = adapter.directory(spark, sf_dir).withColumnRenamed("user_id", "user")
    return enrich.join_attributes(labelled, people, "user")


# --- unions, sorts, distinct ------------------------------------------------


@query(
    "r1_sorted_log",
    f"WITH {ACT} SELECT id, user_id, date FROM act ORDER BY user_id, date, id",
)
def sorted_log(spark: Spark, sf_dir: str) -> DataFrame:
    return adapter.activity_log(spark, sf_dir).select("id", "user_id", "date").orderBy("user_id", "date", "id")


@query(
    "r6_diagonal_union",
    f"""WITH {ACT} SELECT id, CASE WHEN activity_type = 'logon' THEN activity END AS activity,
    CASE WHEN activity_type = 'http' THEN size END AS size, CASE WHEN activity_type = 'file' THEN pc_id END AS pc_id FROM act""",
)
def diagonal_union(spark: Spark, sf_dir: str) -> DataFrame:
    act = adapter.activity_log(spark, sf_dir)

    def of(kind: str, *columns: str) -> DataFrame:
        return act.where(F.col("activity_type") == kind).select("id", *columns)

    return ordering.union_all([of("logon", "activity"), of("http", "size"), of("file", "pc_id"), of("device")])


@query(
    "r7_same_schema_union",
    "SELECT activity, count(*) * 2 AS n FROM (WITH " + ACT + " SELECT * FROM act) GROUP BY 1",
)
def same_union(spark: Spark, sf_dir: str) -> DataFrame:
    act = adapter.activity_log(spark, sf_dir).select("id", "activity")
    return act.unionByName(act).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r11_distinct_pairs",
    f"WITH {ACT} SELECT DISTINCT user_id, dataset FROM act",
)
def distinct_pairs(spark: Spark, sf_dir: str) -> DataFrame:
    return adapter.activity_log(spark, sf_dir).select("user_id", "dataset").distinct()


@query(
    "r4_most_active_users",
    f"""WITH {ACT}, c AS (SELECT user_id, count(*) AS events FROM act GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY events DESC, user_id) AS rk FROM c)
    SELECT user_id, events FROM k WHERE rk <= (SELECT greatest(1, CAST(floor(count(*) * 0.01) AS BIGINT)) FROM c)""",
)
def most_active(spark: Spark, sf_dir: str) -> DataFrame:
    return labelling.most_active_users(adapter.activity_log(spark, sf_dir))


@query(
    "r4_label_most_active",
    f"""WITH {ACT}, c AS (SELECT user_id, count(*) AS events FROM act GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY events DESC, user_id) AS rk FROM c)
    SELECT id, user_id, CASE WHEN user_id IN (SELECT user_id FROM k WHERE rk <=
      (SELECT greatest(1, CAST(floor(count(*) * 0.01) AS BIGINT)) FROM c)) THEN 1 ELSE 0 END AS is_insider FROM act""",
)
def label_active(spark: Spark, sf_dir: str) -> DataFrame:
    return labelling.label_most_active(adapter.activity_log(spark, sf_dir).select("id", "user_id"))


@query(
    "r5_label_outliers",
    f"""WITH {DAILY}, m AS (SELECT "user", day, ({" + ".join(f"abs({m})" for m in profiles.DAILY_MEASURES)}) / {len(profiles.DAILY_MEASURES)}.0::DOUBLE AS z FROM daily)
    SELECT "user", day, {r('z')} AS mean_zscore, CAST(z > (SELECT quantile_cont(z, 0.998) FROM m) AS INTEGER) AS is_insider FROM m""",
)
def label_outliers(spark: Spark, sf_dir: str) -> DataFrame:
    measures = list(profiles.DAILY_MEASURES)
    daily = stages.daily(spark, sf_dir).select("user", "day", *measures)
    found = labelling.label_outliers(daily, measures)
    return found.select("user", "day", F.round("mean_zscore", 6).alias("mean_zscore"), "is_insider")
