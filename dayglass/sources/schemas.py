"""Column layouts of the raw logs."""

from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType


def _layout(*names: str) -> StructType:
    return StructType(
        [StructField(n, LongType() if n == "size" else StringType()) for n in names]
    )


# Column order of files without a header line.
HEADERLESS = {
    "http": _layout("id", "date", "user_id", "pc_id", "url"),
    "logon": _layout("id", "date", "user_id", "pc_id", "activity"),
    "device": _layout("id", "date", "user_id", "pc_id", "activity"),
    "email": _layout(
        "id", "date", "user_id", "pc_id", "to", "cc", "bcc", "from",
        "activity", "size", "attachments", "content",
    ),
    "file": _layout("id", "date", "user_id", "pc_id", "filename", "content"),
}
