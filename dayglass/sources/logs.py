"""Raw activity logs: CSV scan, header sniff, dataset discovery, standard columns."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass import config
from dayglass.functions import text
from dayglass.operators.ordering import union_all
from dayglass.sources.schemas import HEADERLESS


_SNIFFED_BYTES = 1 << 16  # of a file, at most


def _first_line(spark: SparkSession, file: str) -> str:
    """The first line of one file, from its first bytes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        line = jvm.org.apache.hadoop.io.Text()
        reader = jvm.org.apache.hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream)
        reader.readLine(line, _SNIFFED_BYTES, _SNIFFED_BYTES)
        return line.toString()
    finally:
        stream.close()


def has_header(spark: SparkSession, path: str) -> bool:
    """False when the first lines start with ``{``, the mark of files without header.

    All files of a folder must agree; a mixed folder is refused. The files are listed and
    each is opened for its first bytes only, so no job runs and what is read does not grow
    with the log. Empty files do not count.
    """
    files = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(16) as pool:
        firsts = [line.strip() for line in pool.map(lambda f: _first_line(spark, f), files)]
    bare = {line.startswith("{") for line in firsts if line}
    if len(bare) > 1:
        raise ValueError(f"{path} mixes files with and without header")
    return bare != {True}


def read_log_csv(spark: SparkSession, path: str, kind: str, multi_line: bool = False) -> DataFrame:
    """One log kind as text columns (``size`` as long); unreadable cells become null.

    ``multi_line`` allows line breaks inside quoted cells but makes a file
    unsplittable, so it is off by default.
    """
    reader = spark.read.option("mode", "PERMISSIVE").option("multiLine", multi_line)
    reader = reader.option("escape", '"')
    if has_header(spark, path):
        raw = reader.option("header", True).csv(path)
        if "size" in raw.columns:
            raw = raw.withColumn("size", F.col("size").try_cast("long"))
        return raw
    return reader.schema(HEADERLESS[kind]).csv(path)


def standardise(raw: DataFrame, kind: str, dataset: str | None = None) -> DataFrame:
    """Common names, kind and dataset columns, parsed date, and the kind's own flags."""
    columns = raw.columns
    if "user" in columns:
        df = raw.withColumnRenamed("user", "user_id")
    elif "user_id" in columns:
        df = raw
    elif "from" in columns and kind == "email":
        df = raw.withColumnRenamed("from", "user_id")
    else:
        df = raw.withColumn("user_id", F.lit("UNKNOWN"))
    if "pc" in columns:
        df = df.withColumnRenamed("pc", "pc_id")
    elif "pc_id" not in columns:
        df = df.withColumn("pc_id", F.lit(None).cast("string"))
    added = {"activity_type": F.lit(kind)}
    if dataset is not None:
        added["dataset"] = F.lit(dataset)
    if dict(df.dtypes).get("date") == "string":
        added["date"] = text.parse_activity_time(F.col("date"))
    return df.withColumns(added | kind_columns(df, kind))


def kind_columns(df: DataFrame, kind: str) -> dict:
    """Flags derived from one log kind, for the columns that the file has."""
    columns = df.columns
    if kind == "logon" and "activity" in columns:
        return {
            "is_logon": (F.col("activity") == "Logon").cast("byte"),
            "is_logoff": (F.col("activity") == "Logoff").cast("byte"),
        }
    if kind == "device" and "activity" in columns:
        return {
            "is_connect": (F.col("activity") == "Connect").cast("byte"),
            "is_disconnect": (F.col("activity") == "Disconnect").cast("byte"),
        }
    if kind == "email":
        out = {
            "email_size_kb": F.lit(0.0),
            "is_large_email": F.lit(0).cast("byte"),
            "has_attachment": F.lit(0).cast("byte"),
        }
        if "size" in columns:
            out["email_size_kb"] = F.col("size") / F.lit(1024)
            out["is_large_email"] = (F.col("size") > config.LARGE_EMAIL_BYTES).cast("byte")
        if "attachments" in columns:
            out["has_attachment"] = F.col("attachments").isNotNull().cast("byte")
        return out
    if kind == "http" and "url" in columns:
        host = text.url_host(F.col("url"))
        return {"domain": host, "is_suspicious_domain": text.is_suspicious_host(host)}
    if kind == "file" and "filename" in columns:
        extension = text.file_extension(F.col("filename"))
        return {
            "file_extension": extension,
            "is_sensitive_file": text.is_sensitive_extension(extension),
        }
    return {}


def find_datasets(spark: SparkSession, root: str, subset: Iterable[str] | None = None) -> list[str]:
    """Names of dataset folders below ``root``: the wanted ones that exist, else all ``r*``.

    The listing is of folders, not of rows.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(
        s.getPath().getName()
        for s in files.globStatus(hadoop.Path(folder, "r*")) or []
        if s.isDirectory()
    )
    return [d for d in subset if d in found] if subset else found


def read_logs(
    spark: SparkSession,
    root: str,
    subset: Iterable[str] | None = config.DATASETS,
    kinds: Iterable[str] = config.LOG_KINDS,
    multi_line: bool = False,
) -> DataFrame:
    """All logs ``root/<dataset>/<kind>.csv`` as one table; absent files are skipped."""
    frames = []
    for dataset in find_datasets(spark, root, subset):
        for kind in kinds:
            try:
                raw = read_log_csv(spark, f"{root}/{dataset}/{kind}.csv", kind, multi_line)
            except AnalysisException as missing:
                if "PATH_NOT_FOUND" not in (missing.getCondition() or ""):
                    raise
                continue
            frames.append(standardise(raw, kind, dataset))
    if not frames:
        raise FileNotFoundError(f"no logs below {root}")
    return union_all(frames)


def dataset_of_path(path: Column) -> Column:
    """Dataset folder of a file path, for logs read by one glob."""
    return F.nullif(F.regexp_extract(path, r"/(r[^/]+)/[^/]+(?:/[^/]+)?$", 1), F.lit(""))
