"""Quality metrics per event-time window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.dates import timestamp_of
from siltworks.functions.numbers import NATIVE_NUMERIC, number_of, present
from siltworks.operators.profiling import SENTINELS


def windowed_quality(df: DataFrame, ts: str, column: str, width: str = "1 day", lateness: str | None = "1 hour", as_of: dt.date | None = None) -> DataFrame:
    """Rows, completeness, sentinel share, and dates beyond ``as_of``, per tumbling window; the same on batch and stream.

    The watermark bounds the state to the windows still open. Time columns without a zone are read as UTC.
    """
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if lateness is not None and df.isStreaming:
        timed = timed.withWatermark("_ts", lateness)
    dtype = df.schema[column].dataType
    x = number_of(column, dtype) if isinstance(dtype, NATIVE_NUMERIC) else F.lit(None).cast("double")
    future = F.lit(False) if as_of is None else timestamp_of(ts, df.schema[ts].dataType) > F.lit(as_of).cast("timestamp")
    out = timed.groupBy(F.window("_ts", width)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(present(column, dtype).cast("double")).alias("completeness"),
        F.avg(F.when(x.isNotNull(), x.isin(*[float(s) for s in SENTINELS]).cast("double"))).alias("sentinel_share"),
        F.count_if(F.coalesce(future, F.lit(False))).alias("future_dates"),
    )
    return out.select(F.col("window.start").alias("window_start"), "rows", "completeness", "sentinel_share", "future_dates")
