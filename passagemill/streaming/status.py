"""Index status from a stream of log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def status_stream(log: DataFrame, keys: Sequence[str] = (), late: str = "1 hour", span: str = "1 hour") -> DataFrame:
    """Status at the end of every ``span`` and key of a log ``ts, seq, status, error``; write it with output mode ``update``.

    State holds only the spans that the watermark, ``late`` behind the newest row, has not passed.
    Rows of older spans are not taken and are counted (``late_rows``), by the watermark that held for the
    batch before. Rows without a time belong to no span and are left out.
    ``folded`` makes the current status of what was written.
    """
    at = F.struct("ts", "seq")
    spans = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", span).alias("span"), *keys)
    return spans.agg(
        F.max(at).alias("at"),
        F.max_by(F.struct("status", "error"), at).alias("last"),
        F.max(F.when(F.col("status") == "synced", F.col("ts"))).alias("last_reindexed_at"),
    )


def folded(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Current status per key, as ``catalogue.current_status`` has it, of written spans; a span may be there several times."""
    out = spans.groupBy(*keys).agg(
        F.max_by("last", "at").alias("last"), F.max("last_reindexed_at").alias("last_reindexed_at"), F.max("at.ts").alias("updated_at")
    )
    return out.select(*keys, "last.status", F.col("last.error").alias("last_error"), "last_reindexed_at", "updated_at")


def late_rows(query: StreamingQuery) -> int:
    """Rows the query left out for being late, after Spark merged those of one key and span in a task."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
