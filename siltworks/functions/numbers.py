"""Numeric coercion: dirty text or native numbers to finite doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")

# Plain decimal notation only: Java-style suffixes (``1d``), hex and digit separators stay text.
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_RE = r"^\s*[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])\s*$"
UNIT_NUMBER_RE = r"^\s*([+-]?\d+(\.\d+)?)\s*[A-Za-z/]+\s*$"

NATIVE_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)


def finite(c: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(F.abs(c) < F.lit(INF), c)


def text_to_number(c: Column) -> Column:
    """Text to a finite double; anything else is null."""
    return F.when(c.rlike(NUMBER_RE), finite(F.trim(c).try_cast("double")))


def number_of(name: str, dtype: T.DataType) -> Column:
    """The finite double behind a column of any type; null where there is none."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return text_to_number(c)
    if isinstance(dtype, FLOATING):
        return finite(c.cast("double"))
    if isinstance(dtype, NATIVE_NUMERIC):
        return c.cast("double")
    return F.lit(None).cast("double")


def coded_number(name: str, dtype: T.DataType) -> Column:
    """A column's numeric reading in one double: null is missing, NaN is a value that is no number, infinities stay."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        number = F.coalesce(text_to_number(c), F.when(c.rlike(INFINITY_RE), F.lit(INF)), F.lit(float("nan")))
        return F.when(c.isNotNull(), number)
    if isinstance(dtype, FLOATING):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double")


def infinity_flag(name: str, dtype: T.DataType) -> Column:
    """True where the value is an infinity, written or native."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return c.rlike(INFINITY_RE)
    if isinstance(dtype, FLOATING):
        return F.abs(c) == F.lit(INF)
    return F.lit(False)


def present(name: str, dtype: T.DataType) -> Column:
    """True where the value counts as non-null: NaN counts as missing."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, FLOATING):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def unit_number(c: Column) -> Column:
    """``120 mmHg`` or ``10mg`` to its number; a plain number passes; everything else is null."""
    return F.coalesce(text_to_number(c), text_to_number(F.nullif(F.regexp_extract(c, UNIT_NUMBER_RE, 1), F.lit(""))))


def adjusted_skewness(skew: Column, n: Column) -> Column:
    """Population skewness to the bias-adjusted form; null below three values."""
    m = n.cast("double")
    return F.when(n >= 3, finite(skew * F.sqrt(m * (m - 1)) / (m - 2)))


def adjusted_kurtosis(kurt: Column, n: Column) -> Column:
    """Population excess kurtosis to the bias-adjusted form; null below four values."""
    m = n.cast("double")
    return F.when(n >= 4, finite(((m + 1) * kurt + 6) * (m - 1) / ((m - 2) * (m - 3))))
