"""Cleaning actions: narrow column expressions, plus duplicate removal."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.dates import timestamp_of
from siltworks.functions.hashing import row_digest
from siltworks.functions.numbers import FLOATING, finite, number_of, unit_number
from siltworks.functions.strings import blank_to_null, null_tokens_to_null
from siltworks.operators.inference import quoted


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that are already gone are no error."""
    return df.drop(*[c for c in columns if c in df.columns])


def drop_rows(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is true go; where it is unknown they stay."""
    return df.where(~F.coalesce(F.expr(condition), F.lit(False)))


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"column '{column}' not found: {df.columns}")
    return df.withColumnRenamed(column, new_name)


def cast_column(df: DataFrame, column: str, to: str) -> DataFrame:
    """To a number, an integer, a date, a timestamp or text; what does not convert becomes null."""
    dtype = df.schema[column].dataType
    if to in ("double", "float"):
        out = number_of(column, dtype).cast(to)
    elif to in ("int", "bigint", "long"):
        out = number_of(column, dtype).try_cast("bigint" if to == "long" else to)
    elif to in ("date", "timestamp"):
        out = timestamp_of(column, dtype).cast(to)
    else:
        out = quoted(column).try_cast(to)
    return df.withColumn(column, out)


def set_expression(df: DataFrame, column: str, sql: str) -> DataFrame:
    """Replace an existing column by a SQL expression."""
    if column not in df.columns:
        raise ValueError(f"column '{column}' not found: {df.columns}")
    return df.withColumn(column, F.expr(sql))


def null_sentinels(df: DataFrame, column: str, values: list) -> DataFrame:
    """Listed values become null; the row stays."""
    return df.withColumn(column, F.when(~quoted(column).isin(*values), quoted(column)))


def null_tokens(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, null_tokens_to_null(quoted(column)))


def null_outside(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Numbers outside the range become null; text is read as a number first."""
    x = number_of(column, df.schema[column].dataType)
    keep = x.isNotNull()
    keep = keep & (x >= low) if low is not None else keep
    keep = keep & (x <= high) if high is not None else keep
    native = x if isinstance(df.schema[column].dataType, T.StringType) else quoted(column)
    return df.withColumn(column, F.when(keep, native))


def extract_units(df: DataFrame, column: str) -> DataFrame:
    """``120 mmHg`` to 120; plain numbers stay, everything else becomes null."""
    return df.withColumn(column, unit_number(quoted(column)))


def null_future_dates(df: DataFrame, column: str, as_of: dt.date | str) -> DataFrame:
    """Dates after ``as_of`` become null; the row stays, and so does the column's type."""
    d = timestamp_of(column, df.schema[column].dataType)
    return df.withColumn(column, F.when(d <= F.lit(str(as_of)).cast("timestamp"), quoted(column)))


def null_non_finite(df: DataFrame, column: str | None = None) -> DataFrame:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING) and column in (None, f.name)]
    return df.withColumns({n: finite(quoted(n)) for n in names}) if names else df


def trim_text(df: DataFrame, column: str) -> DataFrame:
    """Trimmed, blank to null; nulls stay null."""
    return df.withColumn(column, blank_to_null(quoted(column)))


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """The one row drop on missing values: rows without a target."""
    return df.where(quoted(target).isNotNull())


def drop_duplicate_rows(df: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row per key, the first by ``order``, then by the remaining columns; equal rows are one.

    An aggregate with partial results keeps one row per key and task, so a group of copies of any size shrinks before
    the shuffle and never meets in one task as a whole. A row travels once, its columns in the order that decides; maps,
    which have no order, travel beside it and decide nothing.
    """
    keys = keys or df.columns
    maps = [f.name for f in df.schema.fields if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()]
    first = [c for c in order or [] if c not in maps]
    ranked = first + [c for c in df.columns if c not in first and c not in maps]
    row = F.struct(*[quoted(c) for c in ranked])
    if maps:
        found = F.min_by(F.struct(*[quoted(c) for c in ranked + maps]), row)
    else:
        found = F.min(row)
    kept = df.groupBy(row_digest(keys).alias("_digest")).agg(found.alias("_row"))
    return kept.select(*[F.col(f"_row.`{c}`") for c in df.columns])
