"""Incremental log intake: new files since the last run, then stop.

The batch counterpart reads everything in chunks and appends; here Structured
Streaming keeps track of the files already taken, with exactly-once output.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from dayglass.sources.logs import standardise
from dayglass.sources.schemas import HEADERLESS


def ingest_new_files(
    spark: SparkSession,
    source: str,
    kind: str,
    dataset: str,
    out: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Append header-less files of one kind below ``source`` to the unified log at ``out``.

    ``checkpoint`` is a folder all executors share and that is kept between runs.
    """
    raw = (
        spark.readStream.schema(HEADERLESS[kind])
        .option("maxFilesPerTrigger", files_per_batch)
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .csv(source)
    )
    return (
        standardise(raw, kind, dataset)
        .writeStream.format("parquet")
        .partitionBy("dataset")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start(out)
    )
