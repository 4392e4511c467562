"""Read-only investigation operators; each answers one question about a table with a small frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.dates import timestamp_of
from siltworks.functions.numbers import NATIVE_NUMERIC, finite, number_of, present
from siltworks.operators.frequency import restore_long_values, top_per_column, value_frequency
from siltworks.operators.inference import COLUMN_CHUNK, long_rows, quoted
from siltworks.session import pin_small

# Default sizes of the reports.
INSPECT_ROWS, PAIRS, VIOLATION_SAMPLES, BINS, CATEGORIES = 5, 10, 5, 20, 25
NULL_OVERLAP, NULL_PAIRS, CORRELATIONS = 0.5, 20, 10
# Columns whose null flags share a number, and rows that are multiplied at once.
MASK_BITS, MASK_ROWS = 62, 4096


class InvestigationError(ValueError):
    """The question cannot be asked of this table; the message says why."""


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InvestigationError(f"no such column: {', '.join(missing)}; the table has {df.columns}")


def matching(df: DataFrame, predicate: str) -> DataFrame:
    """Rows that fulfil a SQL predicate; a predicate that does not resolve is an error before any job runs."""
    try:
        out = df.where(F.expr(predicate))
        out.schema  # noqa: B018 - resolves the plan
    except (AnalysisException, ParseException) as error:
        raise InvestigationError(f"this cannot be asked: {error}") from error
    return out


def count_matching(df: DataFrame, predicate: str) -> DataFrame:
    return matching(df, predicate).agg(F.count(F.lit(1)).alias("matches"))


def inspect_rows(df: DataFrame, predicate: str, key: str, limit: int = INSPECT_ROWS) -> DataFrame:
    """The first ``limit`` matching rows by key, each beside the total number of matches."""
    rows = matching(df, predicate)
    first = rows.orderBy(quoted(key)).limit(limit)
    return first.withColumn("matches", count_matching(df, predicate).scalar())


def cross_column_frequency(df: DataFrame, a: str, b: str, top_n: int = PAIRS) -> DataFrame:
    """Most frequent value pairs with their share of all rows, pairs that never occur last.

    Pairs with a null are left out. Impossible pairs only reach the report when fewer than ``top_n`` pairs occur at
    all; in that case the occurring pairs hold every value, so the missing combinations come from at most ``top_n``
    rows, and no product of the table's values is ever built.
    """
    require(df, a, b)
    base = df.select(quoted(a).alias("a"), quoted(b).alias("b"))
    counted = base.where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("count"))
    occurring = counted.orderBy(F.desc("count"), "a", "b").limit(top_n)
    sides = occurring.agg(F.collect_set("a").alias("as"), F.collect_set("b").alias("bs"))
    grid = sides.select(F.explode("as").alias("a"), "bs").select("a", F.explode("bs").alias("b"))
    never = grid.join(occurring, ["a", "b"], "left_anti").withColumn("count", F.lit(0).cast("long"))
    total = df.agg(F.count(F.lit(1))).scalar()
    pairs = occurring.unionByName(never).orderBy(F.desc("count"), "a", "b").limit(top_n)
    return pairs.select(F.col("a").alias(a), F.col("b").alias(b), "count", F.round(F.col("count") / total * 100, 2).alias("pct"))


def temporal_ordering(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """One row: rows with both dates, how many have the earlier one after the later one, and their percentage."""
    require(df, earlier, later)
    a, b = (timestamp_of(c, df.schema[c].dataType) for c in (earlier, later))
    both = a.isNotNull() & b.isNotNull()
    counted = df.agg(F.count_if(both).alias("valid_rows"), F.count_if(a > b).alias("violations"))
    return counted.withColumn("pct", F.round(F.col("violations") / F.nullif(F.col("valid_rows"), F.lit(0)) * 100, 1))


def temporal_violations(df: DataFrame, earlier: str, later: str, key: str, limit: int = VIOLATION_SAMPLES) -> DataFrame:
    """The first rows by key whose dates are out of order."""
    require(df, earlier, later, key)
    a, b = (timestamp_of(c, df.schema[c].dataType) for c in (earlier, later))
    return df.where(a > b).orderBy(quoted(key)).limit(limit).select(key, earlier, later)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal-width histogram over the finite values; the last bin is closed; bins without values are reported too."""
    require(df, column)
    if not isinstance(df.schema[column].dataType, NATIVE_NUMERIC):
        raise InvestigationError(f"Column '{column}' is not numeric.")
    x = number_of(column, df.schema[column].dataType)
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count_if(present(column, df.schema[column].dataType)).alias("n")).first()
    if span["n"] == 0:
        raise InvestigationError(f"nothing but nulls in {column}")
    if span["lo"] is None:
        raise InvestigationError(f"Column '{column}' has no finite values.")
    lo, hi = span["lo"], span["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    # least() skips nulls, so rows without a finite value go before it.
    known = df.select(x.alias("x")).where("x is not null")
    binned = known.select(F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int").alias("bin"))
    counted = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
        F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"),
    )


def category_distribution(df: DataFrame, column: str, top_n: int = CATEGORIES) -> DataFrame:
    """Most frequent values with their share of the non-null rows, the distinct total and how many stay unlisted."""
    require(df, column)
    freq = value_frequency(df, [column])
    totals = freq.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("non_null"))
    top = restore_long_values(df.select(quoted(column)), top_per_column(freq, top_n))
    return top.join(F.broadcast(totals), "column").select(
        "rank",
        "value",
        F.col("n").alias("count"),
        F.round(F.col("n") / F.col("non_null") * 100, 1).alias("pct"),
        "n_distinct",
        F.greatest(F.col("n_distinct") - top_n, F.lit(0)).cast("long").alias("unlisted"),
    )


def value_distribution(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Histogram for numbers, value counts for everything else; an all-null column is an error."""
    require(df, column)
    if isinstance(df.schema[column].dataType, NATIVE_NUMERIC):
        return histogram(df, column, bins)
    if df.where(quoted(column).isNotNull()).isEmpty():
        raise InvestigationError(f"nothing but nulls in {column}")
    return category_distribution(df, column)


def null_gram(df: DataFrame) -> DataFrame:
    """``(i, j, both_null)`` for the columns ``i`` <= ``j``: rows in which both are null, pairs without any left out.

    Null flags travel to Python as packed bits, ``MASK_BITS`` columns to a number. A task multiplies its masks with their transpose,
    batch by batch, and sends one number per pair of columns, however many null patterns its rows have.
    """
    fields = df.schema.fields
    d = len(fields)

    def packed(block: list[T.StructField]) -> Column:
        out = F.lit(0).cast("long")
        for k, f in enumerate(block):
            out = out.bitwiseOR(F.when(present(f.name, f.dataType), F.lit(0).cast("long")).otherwise(F.lit(1 << k).cast("long")))
        return out

    blocks = [packed(fields[i : i + MASK_BITS]).alias(f"b{i // MASK_BITS}") for i in range(0, d, MASK_BITS)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), dtype=np.int64)
        shifts = np.arange(MASK_BITS)
        for batch in batches:
            words = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            for at in range(0, len(words), MASK_ROWS):
                part = words[at : at + MASK_ROWS]
                bits = ((part[:, :, None] >> shifts) & 1).reshape(len(part), -1)[:, :d].astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "n"])

    return df.select(*blocks).mapInArrow(multiply, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("both_null"))


def null_co_occurrence(df: DataFrame, threshold: float = NULL_OVERLAP, limit: int = NULL_PAIRS) -> DataFrame:
    """Column pairs that are null together: rows null in both over rows null in either."""
    fields = df.schema.fields
    pairs = null_gram(df)
    counted = pin_small(pairs)
    own = counted.where("i = j")
    left, right = own.select("i", F.col("both_null").alias("ti")), own.select("j", F.col("both_null").alias("tj"))
    ratio = F.col("both_null") / (F.col("ti") + F.col("tj") - F.col("both_null"))
    names = F.array(*[F.lit(f.name) for f in fields])
    return (
        counted.where("i < j")
        .join(F.broadcast(left), "i")
        .join(F.broadcast(right), "j")
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= threshold)
        .withColumn("overlap", F.round("ratio", 3))
        .orderBy(F.desc("overlap"), "i", "j")
        .limit(limit)
        .select(F.get(names, F.col("i")).alias("column_a"), F.get(names, F.col("j")).alias("column_b"), "both_null", "overlap")
    )


def correlation_scan(df: DataFrame, target: str, top_n: int = CORRELATIONS) -> DataFrame:
    """Numeric columns by the strength of their Pearson correlation with the target, pairwise complete."""
    require(df, target)
    if not isinstance(df.schema[target].dataType, NATIVE_NUMERIC):
        raise InvestigationError(f"Column '{target}' is not numeric.")
    others = [f for f in df.schema.fields if isinstance(f.dataType, NATIVE_NUMERIC) and f.name != target]
    y = number_of(target, df.schema[target].dataType)
    parts = []
    for start in range(0, len(others), COLUMN_CHUNK):
        chunk = others[start : start + COLUMN_CHUNK]
        wide = df.agg(*[F.corr(number_of(f.name, f.dataType), y).alias(f"r{i}") for i, f in enumerate(chunk)])
        parts.append(long_rows(wide, [F.struct(F.lit(f.name).alias("column"), finite(F.col(f"r{i}")).alias("r")) for i, f in enumerate(chunk)]))
    if not parts:
        return df.sparkSession.createDataFrame([], T.StructType.fromDDL("column string, r double, direction string, strength double"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return (
        out.where("r is not null")
        .withColumn("direction", F.when(F.col("r") > 0, "+").otherwise("-"))
        .withColumn("strength", F.abs("r"))
        .orderBy(F.desc("strength"), "column")
        .limit(top_n)
    )


