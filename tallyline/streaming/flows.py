"""Streams (an extension: the evidence model itself is read whole).

Statements arrive as files of transactions and totals. Nothing needs state
beyond a micro-batch but the events' sections, which a session window closes
once its watermark has passed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reconcile


def arriving(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def reconcile_arrivals(transactions: DataFrame, totals: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of whole statements is reconciled against the totals table and handed to ``write``."""

    def batch(df: DataFrame, number: int) -> None:
        own = totals.join(df.select("statement_id").distinct(), "statement_id", "left_semi")
        write(reconcile.groups(reconcile.judge(df, own), own), number)

    return transactions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def user_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of users' events with their counts; a session is final once the watermark passes its end."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
        .select("user_id", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n", "purchases")
    )
