"""Semantic type inference and per-value coercion of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.dates import text_to_timestamp, timestamp_of
from siltworks.functions.numbers import FLOATING, NATIVE_NUMERIC, finite, infinity_flag, number_of, present, text_to_number
from siltworks.functions.strings import canonical_text

# The semantic types and the share of parseable values that decides.
NUMERIC, CATEGORICAL, DATETIME = "Numeric", "Categorical", "Datetime"
TYPE_SHARE = 0.6
COLUMN_CHUNK = 200
# In tables above so many rows, a text column is read value by value where its values come so often on average and are no longer than this.
MANY_ROWS, REPEATS, VALUE_BYTES = 100_000, 4, 200


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def long_rows(aggregated: DataFrame, structs: list[Column]) -> DataFrame:
    """One wide aggregate row to one row per column."""
    return aggregated.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def repeated_texts(df: DataFrame) -> list[str]:
    """Text columns of a large table with short values that come often: what is asked of each value is asked once per value there.

    One scan with a sketch per column; only the way of counting depends on it, never a count.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = []
    for at in range(0, len(texts), COLUMN_CHUNK):
        part = texts[at : at + COLUMN_CHUNK]
        aggs = [a for i, c in enumerate(part) for a in (F.approx_count_distinct(quoted(c)).alias(f"d{i}"), F.max(F.octet_length(quoted(c))).alias(f"l{i}"))]
        seen = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
        if seen["rows"] > MANY_ROWS:
            out += [c for i, c in enumerate(part) if seen[f"d{i}"] * REPEATS <= seen["rows"] and (seen[f"l{i}"] or 0) <= VALUE_BYTES]
    return out


def value_times(df: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """The different values of a column, null too, and how often each comes."""
    name = f"{column}_times"
    return df.groupBy(quoted(column)).agg(F.count(F.lit(1)).alias(name)), quoted(name)


def times_where(condition: Column, times: Column | None = None) -> Column:
    """How many rows meet a condition; with ``times``, where a row stands for so many."""
    return F.count_if(condition) if times is None else F.coalesce(F.sum(F.when(condition, times)), F.lit(0))


def infer_types(df: DataFrame, columns: list[str] | None = None, share: float = TYPE_SHARE, repeated: list[str] | None = None) -> DataFrame:
    """Semantic type of each column: dates are tried before numbers, over all values of a text column.

    One scan that reads the text columns only; native columns are decided by their physical type. Columns that are
    ``repeated`` are grouped to their values first, and each value is parsed once.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    apart = [f for f in fields if f.name in (repeated or ()) and isinstance(f.dataType, T.StringType)]
    fields = [f for f in fields if f not in apart]
    parts = [_infer_chunk(df, fields[i : i + COLUMN_CHUNK], share) for i in range(0, len(fields), COLUMN_CHUNK)]
    for f in apart:
        values, times = value_times(df, f.name)
        parts.append(_infer_chunk(values, [f], share, times))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _infer_chunk(df: DataFrame, fields: list[T.StructField], share: float, times: Column | None = None) -> DataFrame:
    aggs, structs = [], []
    for i, f in enumerate(fields):
        if isinstance(f.dataType, T.StringType):
            c = quoted(f.name)
            aggs += [
                times_where(c.isNotNull(), times).alias(f"n{i}"),
                times_where(text_to_timestamp(c).isNotNull(), times).alias(f"d{i}"),
                times_where(text_to_number(c).isNotNull(), times).alias(f"m{i}"),
                F.max(F.length(c)).alias(f"l{i}"),
            ]
            n, d, m = (F.col(f"{p}{i}") for p in "ndm")
            inferred = (
                F.when(n == 0, CATEGORICAL)
                .when(d >= share * n, DATETIME)
                .when(m >= share * n, NUMERIC)
                .otherwise(CATEGORICAL)
            )
            mismatch, longest = inferred != CATEGORICAL, F.col(f"l{i}")
        else:
            inferred, mismatch, longest = F.lit(native_type(f.dataType)), F.lit(False), F.lit(None)
        structs.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("actual_dtype"),
                inferred.alias("inferred_type"),
                mismatch.alias("type_mismatch"),
                longest.cast("long").alias("max_length"),
            )
        )
    return long_rows(df.agg(F.lit(1).alias("one"), *aggs), structs)


def native_type(dtype: T.DataType) -> str:
    """Semantic type of a column that is not text."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return NUMERIC if isinstance(dtype, NATIVE_NUMERIC) else CATEGORICAL


def inferred_map(df: DataFrame, columns: list[str] | None = None, repeated: list[str] | None = None) -> dict[str, str]:
    """Column name to semantic type on the driver: one short row per column; no scan when nothing is text."""
    return {c: kind for c, (kind, _) in inferred_with_length(df, columns, repeated).items()}


def inferred_with_length(df: DataFrame, columns: list[str] | None = None, repeated: list[str] | None = None) -> dict[str, tuple[str, int]]:
    """Column name to semantic type and longest text (0 where the column is not text)."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    known = {f.name: (native_type(f.dataType), 0) for f in fields if not isinstance(f.dataType, T.StringType)}
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    if texts:
        known.update({r["column"]: (r["inferred_type"], r["max_length"] or 0) for r in infer_types(df, texts, repeated=repeated_texts(df) if repeated is None else repeated).collect()})
    return {f.name: known[f.name] for f in fields}


def coerce_numeric(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Column to finite double, bad values null."""
    return df.withColumn(out or column, number_of(column, df.schema[column].dataType))


def coerce_datetime(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Column in mixed formats to timestamp, bad values null."""
    return df.withColumn(out or column, timestamp_of(column, df.schema[column].dataType))


def failure_flag(df: DataFrame, column: str, inferred: str) -> Column:
    """True where a present value does not coerce to the inferred type; infinities are their own defect."""
    dtype = df.schema[column].dataType
    there = present(column, dtype)
    if inferred == NUMERIC:
        return there & number_of(column, dtype).isNull() & ~F.coalesce(infinity_flag(column, dtype), F.lit(False))
    if inferred == DATETIME:
        return there & timestamp_of(column, dtype).isNull()
    return F.lit(False)


def coercion_failures(df: DataFrame, types: dict[str, str], k: int = 5) -> DataFrame:
    """Per column: how many present values do not coerce, and the ``k`` smallest distinct raw ones.

    The distinct bad values are pre-aggregated per task; the top-k window keeps ``k`` rows per task before its shuffle.
    """
    from siltworks.operators.frequency import smallest_values

    wanted = {c: t for c, t in types.items() if t != CATEGORICAL}
    if not wanted:
        return df.sparkSession.createDataFrame([], "column string, failures long, samples string")
    bad = [
        F.when(failure_flag(df, c, t), canonical_text(c, df.schema[c].dataType)).alias(c) for c, t in wanted.items()
    ]
    values = df.select(*bad).unpivot([], list(wanted), "column", "value").where("value is not null")
    counted = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("column").agg(F.sum("n").alias("failures"))
    names = df.sparkSession.createDataFrame([(c,) for c in wanted], "column string")
    return (
        names.join(totals, "column", "left")
        .join(smallest_values(counted, k), "column", "left")
        .select("column", F.coalesce("failures", F.lit(0)).alias("failures"), F.coalesce("samples", F.lit("")).alias("samples"))
    )


def json_safe(df: DataFrame) -> DataFrame:
    """Every column as canonical text, so that any row fits a JSON document."""
    return df.select(*[canonical_text(f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def non_finite_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN and infinities of floating columns become null."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING) and (columns is None or f.name in columns)]
    return df.withColumns({n: finite(quoted(n)) for n in names}) if names else df


def model_input(df: DataFrame) -> DataFrame:
    """Numbers as double, everything else as text, booleans as text too."""
    return df.select(
        *[
            (number_of(f.name, f.dataType) if isinstance(f.dataType, NATIVE_NUMERIC) else canonical_text(f.name, f.dataType)).alias(f.name)
            for f in df.schema.fields
        ]
    )
