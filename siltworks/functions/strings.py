"""Text helpers: canonical text, null tokens, signatures, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a missing value (compared trimmed and in upper case).
NULL_TOKENS = ("", "N/A", "NA", "NAN", "NULL", "NONE", "UNKNOWN", "#N/A", "<NA>", "-")


def canonical_text(name: str, dtype: T.DataType) -> Column:
    """Any value as stable text: ISO times, UTF-8 bytes, JSON for nested values, null for NaN."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c + F.lit(0.0).cast(dtype)).cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.replace(c.cast("string"), F.lit(" "), F.lit("T"))
    if isinstance(dtype, T.BinaryType):
        return F.make_valid_utf8(c.cast("string"))
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def null_tokens_to_null(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Blank text and texts that stand for a missing value become null."""
    return F.when(~F.upper(F.trim(c)).isin(*tokens), c)


def signature(c: Column) -> Column:
    """Shape of a text: letters ``A``, digits ``9``, white space ``_``, everything else ``.``."""
    shape = F.regexp_replace(c, r"[^\p{L}\p{Nd}\s]", ".")
    shape = F.regexp_replace(shape, r"\p{Nd}", "9")
    shape = F.regexp_replace(shape, r"\p{L}", "A")
    return F.regexp_replace(shape, r"\s", "_")


def truncate_with_length(c: Column, n: int) -> Column:
    """Cut text longer than ``n`` characters and say how long it was."""
    return F.when(
        F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("... [truncated, "), F.length(c).cast("string"), F.lit(" chars total]"))
    ).otherwise(c)


def normalised_text(c: Column) -> Column:
    """Lower case, letters and digits only, single spaces: the form in which near copies are equal."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", " "))
