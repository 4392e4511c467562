"""Feature expressions. All but frequency encoding are narrow: one new column from columns of the same row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.hashing import hash_bucket
from siltworks.operators.inference import quoted
from siltworks.operators.skew import skew_safe_lookup

NUMERIC_TRANSFORMS = ("log1p", "sqrt", "power", "abs", "reciprocal")
INTERACTIONS = ("ratio", "difference", "product", "sum")
DATE_PARTS = ("year", "month", "day", "dayofweek", "hour", "is_weekend")
ROW_AGGREGATES = ("sum", "mean", "count")
TEXT_MEASURES = ("length", "tokens", "matches")


def numeric_transform(column: str, kind: str, exponent: float = 2.0) -> Column:
    c = quoted(column).cast("double")
    clipped = F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    return {
        "log1p": F.log1p(clipped),
        "sqrt": F.sqrt(clipped),
        "power": F.pow(c, F.lit(exponent)),
        "abs": F.abs(c),
        "reciprocal": F.try_divide(F.lit(1.0), c),
    }[kind]


def interaction(a: str, b: str, kind: str) -> Column:
    """Two columns combined; a zero denominator gives null."""
    x, y = quoted(a).cast("double"), quoted(b).cast("double")
    return {"ratio": x / F.nullif(y, F.lit(0.0)), "difference": x - y, "product": x * y, "sum": x + y}[kind]


def binned(column: str, edges: list[float], labels: list[str] | None = None) -> Column:
    """Left-open, right-closed bins; outside the edges null."""
    names = labels or [str(i) for i in range(len(edges) - 1)]
    if len(names) != len(edges) - 1 or sorted(edges) != list(edges):
        raise ValueError("edges must ascend and be one more than the labels")
    c, out = quoted(column), None
    for low, high, name in zip(edges, edges[1:], names):
        inside = (c > low) & (c <= high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def date_part(column: str, part: str) -> Column:
    """Parts of a date; Monday is 0."""
    c = quoted(column)
    return {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "dayofweek": F.weekday(c),
        "hour": F.hour(c.cast("timestamp")),
        "is_weekend": (F.weekday(c) >= 5).cast("int"),
    }[part]


def hash_encoded(column: str, buckets: int) -> Column:
    return hash_bucket(quoted(column).cast("string"), buckets)


def row_aggregate(columns: list[str], kind: str) -> Column:
    """Sum, mean or count over columns of one row, nulls skipped; the sum of nothing is 0."""
    known = F.filter(F.array(*[quoted(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    return {"sum": total, "mean": total / F.nullif(F.size(known), F.lit(0)), "count": F.size(known)}[kind]


def text_measure(column: str, kind: str, pattern: str = "") -> Column:
    c = F.coalesce(quoted(column), F.lit(""))
    return {
        "length": F.length(c),
        "tokens": F.size(F.filter(F.split(c, r"\s+"), lambda t: t != "")),
        "matches": c.rlike(pattern).cast("int"),
    }[kind]


def missing_pattern(columns: list[str]) -> Column:
    """One character per column, 1 where it is null."""
    return F.concat(*[F.when(quoted(c).isNull(), "1").otherwise("0") for c in columns])


def value_counts(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """How often each value occurs: the fitted state of frequency encoding."""
    return df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias(column)).agg(F.count(F.lit(1)).alias(out))


def frequency_encoded(df: DataFrame, column: str, out: str, fitted: DataFrame | None = None) -> DataFrame:
    """Adds the count of the row's value; null stays null, unseen values are null.

    ``fitted`` carries counts from the training fold; without it they are taken from ``df`` itself.
    """
    counts = value_counts(df, column, "_count") if fitted is None else fitted.toDF(column, "_count")
    lookup = counts.withColumn("_value", F.col("_count"))
    return skew_safe_lookup(df, lookup, column, "_count", "_value").withColumnRenamed("_value", out).select(*df.columns, out)
