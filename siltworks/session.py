"""Session helpers: Spark settings, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A frame is only ever broadcast when it was counted to hold at most this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 * 1024 * 1024
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def build_session(app: str = "siltworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; cluster settings given by ``spark-submit`` win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables: ``spark.checkpoint.dir``, or the folder a program has set.

    Where neither is named, a folder below the warehouse, which driver and executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if root is None and current.isDefined():
        return current.get()
    if root is None:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if not current.isDefined():
        context.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder so that later passes do not replay earlier ones."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the checkpoint root for a written table."""
    return os.path.join(checkpoint_root(spark), f"{name}-{os.urandom(6).hex()}")


def pin_small(df: DataFrame, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Turn a frame proven to be small, in rows and in bytes, into a broadcast local relation.

    A larger frame comes back unchanged, and the join it feeds stays a shuffle join that AQE may split. At most
    ``limit`` + 1 rows are looked at; where columns have no fixed width their bytes are summed before anything is gathered.
    """
    head = df.limit(limit + 1)
    loose = [f.name for f in df.schema.fields if not isinstance(f.dataType, FIXED_WIDTH)]
    if loose:
        head = head.persist()
        width = sum((F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c in loose[1:]), F.octet_length(F.to_json(F.struct(F.col(f"`{loose[0]}`")))))
        count, size = head.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
        rows = head.collect() if count <= limit and size <= max_bytes else None
        head.unpersist()
    else:
        rows = head.collect()
        rows = rows if len(rows) <= limit else None
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
