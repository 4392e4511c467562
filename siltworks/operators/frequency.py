"""The value-frequency table: one row per column and distinct value, the base of most column statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.hashing import seeded_md5
from siltworks.functions.strings import canonical_text

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Longer values travel through the shuffle as their beginning and a 128-bit digest; the few that are reported are looked up afterwards.
LONG_VALUE = 256


def value_key(c: Column, long_value: int = LONG_VALUE) -> Column:
    """The value itself, or its first characters followed by its digest when it is long: equal keys are equal values, in order of the values."""
    return F.when(F.length(c) > long_value, F.concat(F.substring(c, 1, long_value), F.md5(c))).otherwise(c)


def value_frequency(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, n)`` over non-null values: unpivot, partial count per task, one shuffle of distinct values."""
    return _counted(_text_pairs(df, [f for f in df.schema.fields if columns is None or f.name in columns]))


def typed_frequencies(df: DataFrame, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """Frequency tables by kind: whole numbers as ``long``, doubles as ``double``, everything else as ``text``.

    Numbers are grouped and shuffled as eight bytes; only the few that are reported ever become text. Each table reads
    its own columns only.
    """
    return {kind: _counted(pairs) for kind, (_, pairs) in typed_pairs(df, columns).items()}


def typed_pairs(df: DataFrame, columns: list[str] | None = None) -> dict[str, tuple[list[str], DataFrame]]:
    """By kind: the columns, and ``(column, value)`` of every non-null value."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    out = {}
    for kind, types in (("long", WHOLE), ("double", (T.DoubleType,))):
        names = [f.name for f in fields if isinstance(f.dataType, types)]
        if names:
            values = [F.col(f"`{n}`").cast("long") if kind == "long" else _plain_double(F.col(f"`{n}`")) for n in names]
            pairs = df.select(*[v.alias(n) for v, n in zip(values, names)]).unpivot([], names, "column", "value")
            out[kind] = names, pairs.where("value is not null")
    texts = [f for f in fields if not isinstance(f.dataType, (*WHOLE, T.DoubleType))]
    if texts:
        out["text"] = [f.name for f in texts], _text_pairs(df, texts)
    return out


def _text_pairs(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    texts = [
        (value_key(canonical_text(f.name, f.dataType)) if _may_be_long(f.dataType) else canonical_text(f.name, f.dataType)).alias(f.name)
        for f in fields
    ]
    return df.select(*texts).unpivot([], [f.name for f in fields], "column", "value").where("value is not null")


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _plain_double(c: Column) -> Column:
    """NaN is missing and negative zero is zero."""
    return F.when(~F.isnan(c), c + F.lit(0.0))


def _may_be_long(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType))


def top_per_column(freq: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """The ``k`` most frequent values per column with their rank, ties by value.

    Spark limits each group inside every task before the shuffle, so a column of any cardinality moves k rows per task.
    """
    w = W.partitionBy("column").orderBy(*(order or [F.desc("n"), F.asc("value")]))
    return freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def restore_long_values(df: DataFrame, few: DataFrame) -> DataFrame:
    """Keys of long values in ``few`` (``column``, ``value`` and more; k rows per column) back to whole texts, by one more scan."""
    fields = [f for f in df.schema.fields if _may_be_long(f.dataType)]
    if not fields:
        return few
    texts = df.select(*[canonical_text(f.name, f.dataType).alias(f.name) for f in fields])
    pairs = texts.unpivot([], [f.name for f in fields], "column", "whole").where(F.length("whole") > LONG_VALUE)
    keyed = pairs.select("column", value_key(F.col("whole")).alias("value"), "whole")
    wanted = few.where(F.length("value") > LONG_VALUE).select("column", "value").distinct()
    found = keyed.join(F.broadcast(wanted), ["column", "value"]).groupBy("column", "value").agg(F.any_value("whole").alias("whole"))
    return few.join(found, ["column", "value"], "left").withColumn("value", F.coalesce("whole", "value")).drop("whole")


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """``(column, rank, value, n)``: the most frequent whole values of each column."""
    out = None
    for kind, freq in typed_frequencies(df, columns).items():
        top = top_per_column(freq, k).withColumn("value", F.col("value").cast("string"))
        top = restore_long_values(df, top) if kind == "text" else top
        one = top.select("column", "rank", "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def frequency_stats(freq: DataFrame) -> DataFrame:
    """Distinct count, values seen once, and the count of the most frequent value, per column."""
    return freq.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.count_if(F.col("n") == 1).alias("n_unique"),
        F.max("n").alias("top_count"),
        F.sum("n").alias("non_null"),
    )


def smallest_values(freq: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` smallest values per column joined by ``|``."""
    top = top_per_column(freq, k, [F.asc("value")])
    return top.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("samples"))


def sample_values(df: DataFrame, key: str, columns: list[str] | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """``k`` non-null values per column from the rows with the smallest seeded digest of their key."""
    fields = [f for f in df.schema.fields if f.name != key and (columns is None or f.name in columns)]
    texts = [canonical_text(f.name, f.dataType).alias(f.name) for f in fields]
    keyed = df.select(seeded_md5(F.col(f"`{key}`"), seed).alias("_digest"), *texts)
    pairs = keyed.unpivot(["_digest"], [f.name for f in fields], "column", "value").where("value is not null")
    w = W.partitionBy("column").orderBy("_digest", "value")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("column", "rank", "value")
