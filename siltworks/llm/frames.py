"""What the corpus operators share: reading, writing below the shared folder, and bytes in Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows of one Arrow batch that Python hands back.
BATCH_ROWS = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read again: later passes neither repeat nor contradict it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, column: str = "uid") -> DataFrame:
    """``df`` written once with a number for each row in ``column``: every later pass reads the same number beside a row."""
    return written(df.withColumn(column, F.monotonically_increasing_id()), name)


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_mark(text: Column) -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b"))


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name


def octets(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def arrow_batches(schema: T.StructType, rows: Iterator[tuple], size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches of at most ``size`` rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held.clear()
    if held:
        yield batch()


def map_rows(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields row tuples."""
    kind = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from arrow_batches(kind, function(batches))
        give_back()

    return df.mapInArrow(run, kind)


def give_back() -> None:
    """Memory that a task has freed goes back to the system: a worker process outlives its task, and idle ones count beside the busy."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def crc_fold(doc_id: Column) -> Column:
    """True for the rows held out of every training: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
