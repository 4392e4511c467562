"""The event tail: deliver each event once, however often the source repeats it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated_tail(df: DataFrame, session: str, seq: str, ts: str, lateness: str = "1 hour") -> DataFrame:
    """Events without repeats of ``(session, seq)``; on a stream repeats are remembered for the lateness only."""
    timed = df.withColumn("event_time", F.col(ts).cast("timestamp"))
    if not df.isStreaming:
        return timed.dropDuplicates([session, seq])
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark([session, seq])


def after(df: DataFrame, seq: str, delivered: int) -> DataFrame:
    """What a reader that has seen everything up to ``delivered`` still needs."""
    return df.where(F.col(seq) > delivered)
