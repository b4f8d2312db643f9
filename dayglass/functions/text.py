"""Text columns: dates, hosts, file names, identifiers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dayglass import config

# The two date layouts; anything else becomes null.
_US_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}:\d{1,2}:\d{1,2})$"
_ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"


def parse_activity_time(text: Column) -> Column:
    """Lenient two-layout parse to a zone-less timestamp.

    The month-first layout is rewritten to the ISO one and cast, so the session
    time zone (and its missing hours) never touches the value.
    """
    iso = F.regexp_replace(F.trim(text), _US_DATE, "$3-$1-$2 $4")
    return F.when(iso.rlike(_ISO_DATE), iso.try_cast("timestamp_ntz"))


def url_host(url: Column) -> Column:
    """Host part of an http(s) URL, null when the URL has none."""
    return F.nullif(F.regexp_extract(url, r"https?://([^/]+)", 1), F.lit(""))


def is_suspicious_host(host: Column, words: Iterable[str] = config.SUSPICIOUS_WORDS) -> Column:
    """1 when the lower-cased host contains any of the words, null for a null host."""
    return F.lower(host).rlike("|".join(words)).cast("byte")


def file_extension(filename: Column) -> Column:
    """Lower-cased text after the last dot; the whole name when it has no dot."""
    return F.lower(F.element_at(F.split(filename, r"\."), -1))


def is_sensitive_extension(
    extension: Column, extensions: Iterable[str] = config.SENSITIVE_EXTENSIONS
) -> Column:
    return extension.isin(*extensions).cast("byte")


def pseudonym(identifier: Column, salt: str = config.PSEUDONYM_SALT) -> Column:
    """Salted SHA-256 pseudonym; null identifiers become ``UNKNOWN``."""
    digest = F.sha2(F.concat(F.lit(salt), identifier.cast("string")), 256)
    return F.coalesce(F.concat(F.lit("USER_"), F.substring(digest, 1, 12)), F.lit("UNKNOWN"))


def normal_dataset_id(raw: Column) -> Column:
    """``'2.0'`` becomes ``r2``, ``'3.1-1'`` becomes ``r3.1``."""
    head = F.split_part(raw.cast("string"), F.lit("-"), F.lit(1))
    return F.concat(F.lit("r"), F.replace(head, F.lit(".0"), F.lit("")))


def prefixed_dataset_id(raw: Column) -> Column:
    """``'4.1'`` and ``'r4.1'`` name the same dataset ``r4.1``."""
    return F.concat(F.lit("r"), F.regexp_replace(raw.cast("string"), "^r", ""))


def display_name(name: Column) -> Column:
    """``isolation_forest`` becomes ``Isolation Forest``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
