"""The audit trail as a stream: entries are appended as Parquet files, and counted per window as they come."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.catalog import audit_rows

log = logging.getLogger(__name__)
AUDIT = "id long, username string, action string, target string, detail string, at_ts timestamp"


def record(rows: DataFrame, path: str) -> bool:
    """S-11: appends entries; a failure is logged, told by False, and never breaks the caller."""
    try:
        audit_rows(rows).write.mode("append").parquet(path)
    except Exception:
        log.warning("audit entries were not written to %s", path, exc_info=True)
        return False
    return True


def entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(AUDIT).parquet(path)


def action_counts(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, action, n) of entries, each id and time counted once.

    Entries later than the watermark are left out of closed windows; ids are remembered as long as it lets their repeats in.
    """
    once = stream.withWatermark("at_ts", late).dropDuplicates(["id", "at_ts"])
    counts = once.groupBy(F.window("at_ts", window), "action").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "action", "n")


def write(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows as Parquet, exactly once; runs until the input that is there has been read."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
