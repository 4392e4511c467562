"""Statistical anomaly summary: numeric outliers by z-score and IQR, rare categories, anomalous rows.

First pass: moments, quartiles and the frequent categories, a bounded handful of numbers per column. Second pass: one
narrow scan with those numbers as literals, so flags stay in generated code and nothing is joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.numbers import NATIVE_NUMERIC, number_of
from siltworks.operators.frequency import LONG_VALUE, restore_long_values, top_per_column, value_frequency, value_key
from siltworks.operators.inference import long_rows, quoted
from siltworks.operators.quantiles import exact_quantiles

# Outlier fences, rarity share and list length.
Z_LIMIT, IQR_FACTOR, RARE_SHARE, RARE_LISTED = 3.0, 1.5, 0.01, 10


@dataclass(frozen=True)
class Fence:
    """Mean and the bounds outside of which a value is an outlier."""

    mean: float
    low_z: float | None
    high_z: float | None
    low_iqr: float | None
    high_iqr: float | None

    def flag(self, x: Column) -> Column:
        hit = F.lit(False)
        for low, high in ((self.low_z, self.high_z), (self.low_iqr, self.high_iqr)):
            if low is not None:
                hit = hit | (x < F.lit(low)) | (x > F.lit(high))
        return F.coalesce(hit, F.lit(False))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NATIVE_NUMERIC)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def fences(df: DataFrame, columns: list[str] | None = None) -> dict[str, Fence]:
    """Outlier bounds of the numeric columns that hold at least two finite values."""
    names = numeric_columns(df) if columns is None else columns
    values = {c: number_of(c, df.schema[c].dataType) for c in names}
    return _bounds(df, values, df.agg(*_moments(values)).first()) if names else {}


def _moments(values: dict[str, Column]) -> list[Column]:
    return [
        a for i, x in enumerate(values.values()) for a in (F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"))
    ]


def _bounds(df: DataFrame, values: dict[str, Column], stats: Row) -> dict[str, Fence]:
    quartiles = exact_quantiles(df, values, (0.25, 0.75))
    out = {}
    for i, c in enumerate(values):
        if stats[f"n{i}"] < 2:
            continue
        mean, std, (q1, q3) = stats[f"m{i}"], stats[f"s{i}"], quartiles[c]
        reach, iqr = Z_LIMIT * std, q3 - q1
        out[c] = Fence(
            mean,
            mean - reach if std > 0 else None,
            mean + reach if std > 0 else None,
            q1 - IQR_FACTOR * iqr if iqr > 0 else None,
            q3 + IQR_FACTOR * iqr if iqr > 0 else None,
        )
    return out


def outlier_counts(df: DataFrame, bounds: dict[str, Fence] | None = None) -> DataFrame:
    """``(column, outlier_count, outlier_direction)`` per numeric column."""
    bounds = fences(df) if bounds is None else bounds
    if not bounds:
        return df.sparkSession.createDataFrame([], "column string, outlier_count long, outlier_direction string")
    aggs, structs = _count_outliers(df, bounds)
    return long_rows(df.agg(*aggs), structs)


def _count_outliers(df: DataFrame, bounds: dict[str, Fence]) -> tuple[list[Column], list[Column]]:
    """Aggregates that count high and low outliers, and the row each column makes of them."""
    aggs, structs = [], []
    for i, (c, fence) in enumerate(bounds.items()):
        x = number_of(c, df.schema[c].dataType)
        flag = fence.flag(x)
        aggs += [F.count_if(flag & (x > fence.mean)).alias(f"h{i}"), F.count_if(flag & (x <= fence.mean)).alias(f"l{i}")]
        high, low = F.col(f"h{i}"), F.col(f"l{i}")
        direction = F.when((high > 0) & (low > 0), "both").when(high > 0, "high").when(low > 0, "low").otherwise("none")
        structs.append(F.struct(F.lit(c).alias("column"), (high + low).alias("outlier_count"), direction.alias("outlier_direction")))
    return aggs, structs


def category_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, n, total)``: frequency table of the text columns beside the column's non-null count."""
    names = text_columns(df) if columns is None else columns
    freq = value_frequency(df, names)
    totals = df.agg(*[F.count(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    known = df.sparkSession.createDataFrame([(c, totals[f"c{i}"]) for i, c in enumerate(names)], "column string, total long")
    return freq.join(F.broadcast(known), "column")


def rare_categories(df: DataFrame, columns: list[str] | None = None, listed: int = RARE_LISTED) -> DataFrame:
    """``(column, rank, value, n)``: the most frequent of the rare values of each text column."""
    rare = category_shares(df, columns).where(F.col("n") < RARE_SHARE * F.col("total"))
    top = restore_long_values(df, top_per_column(rare, listed))
    return top.select("column", "rank", "value", "n")


def common_categories(df: DataFrame, columns: list[str] | None = None) -> dict[str, list[str]]:
    """The values that are not rare: at most 1 / share of them exist per column, however many values there are."""
    names = text_columns(df) if columns is None else columns
    if not names:
        return {}
    out: dict[str, list[str]] = {c: [] for c in names}
    for row in category_shares(df, names).where(F.col("n") >= RARE_SHARE * F.col("total")).select("column", "value").collect():
        out[row["column"]].append(row["value"])
    return out


def anomaly_flag(df: DataFrame, bounds: dict[str, Fence], common: dict[str, list[str]]) -> Column:
    """True for rows that are an outlier in any numeric column or rare in any text column."""
    flags = [f.flag(number_of(c, df.schema[c].dataType)) for c, f in bounds.items()]
    flags += [
        F.coalesce(quoted(c).isNotNull() & (~value_key(quoted(c)).isin(*values) if values else F.lit(True)), F.lit(False))
        for c, values in common.items()
    ]
    out = F.lit(False)
    for flag in flags:
        out = out | flag
    return out


def anomalous_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows there are and how many are anomalous in any column."""
    flag = anomaly_flag(df, fences(df), common_categories(df))
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(flag).alias("total_anomalous_rows"))


def anomaly_summary(df: DataFrame) -> DataFrame:
    """Per column: outlier count and direction, or the listed rare values; beside the row totals.

    Four jobs whatever the number of columns: moments and totals; quartiles; the most frequent categories; the counts.
    The values that are not rare are at most 1 / share per column, so the frequent ones and the listed rare ones
    together are the head of the frequency table.
    """
    values = {c: number_of(c, df.schema[c].dataType) for c in numeric_columns(df)}
    texts = text_columns(df)
    totals = [F.count(quoted(c)).alias(f"t{i}") for i, c in enumerate(texts)]
    stats = df.agg(F.count(F.lit(1)).alias("rows"), *_moments(values), *totals).first()
    bounds = _bounds(df, values, stats) if values else {}
    common: dict[str, list[str]] = {c: [] for c in texts}
    rare: dict[str, list[str]] = {c: [] for c in texts}
    if texts:
        size = {c: stats[f"t{i}"] for i, c in enumerate(texts)}
        heads = top_per_column(value_frequency(df, texts), round(1 / RARE_SHARE) + RARE_LISTED)
        for r in heads.orderBy("column", "rank").collect():
            (common if r["n"] >= RARE_SHARE * size[r["column"]] else rare)[r["column"]].append(r["value"])
    aggs, structs = _count_outliers(df, bounds)
    flag = anomaly_flag(df, bounds, common)
    counted = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(flag).alias("total_anomalous_rows"), *aggs)
    texts_rows = [
        F.struct(F.lit(c).alias("column"), F.lit(0).cast("long").alias("outlier_count"), F.lit("none").alias("outlier_direction")) for c in texts if size[c]
    ]
    rows = counted.select("total_rows", "total_anomalous_rows", F.explode(F.array(*structs, *texts_rows)).alias("r")).select("r.*", "total_rows", "total_anomalous_rows")
    listed = [(c, i + 1, v) for c, found in rare.items() for i, v in enumerate(found[:RARE_LISTED])]
    if not listed:
        return rows.withColumn("rare_categories", F.lit(None).cast("string"))
    few = df.sparkSession.createDataFrame(listed, "column string, rank int, value string")
    few = restore_long_values(df, few) if any(len(v) > LONG_VALUE for _, _, v in listed) else few
    joined = few.groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]), "|").alias("rare_categories")
    )
    return rows.join(F.broadcast(joined), "column", "left")
