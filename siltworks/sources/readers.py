"""Sources: delimited text read as strings, parquet, and keyed column-wise joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.strings import NULL_TOKENS

CORRUPT = "_corrupt_record"
# The texts a delimited file may use for a missing value on reading.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; pruning and pushdown come with the source."""
    return spark.read.parquet(path)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a delimited file, from its first line."""
    return spark.read.csv(path, header=True).columns


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, keep_corrupt: bool = False, multi_line: bool = True) -> DataFrame:
    """Delimited text with a header, every column a string.

    Types are the profile's business: an explicit all-string schema spares the extra scan of schema inference. Texts
    that stand for a missing value become null. With ``keep_corrupt`` malformed lines stay visible in their own column.
    Quoted values may hold line breaks; a file is then read by one task, so a large table comes as many files. Where no
    value has a line break, ``multi_line=False`` splits files too.
    """
    names = columns or csv_header(spark, path)
    fields = [T.StructField(n, T.StringType()) for n in names]
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
    reader = spark.read.schema(T.StructType(fields)).option("header", True).option("mode", "PERMISSIVE")
    reader = reader.option("enforceSchema", False) if not keep_corrupt else reader
    reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line).option("escape", '"')
    df = reader.csv(path)
    return df.select(*[F.when(~F.col(f"`{n}`").isin(*MISSING_TEXTS), F.col(f"`{n}`")).alias(n) for n in df.columns])


def nullify_tokens(df: DataFrame, columns: list[str] | None = None, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Blank and null-like texts of string columns become null."""
    from siltworks.functions.strings import null_tokens_to_null

    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: null_tokens_to_null(F.col(f"`{n}`"), tokens) for n in names})


def concat_columns(features: DataFrame | None, targets: DataFrame | None, key: str) -> DataFrame | None:
    """Features beside targets on an explicit row key; a missing part is skipped, both missing give nothing."""
    if features is None or targets is None:
        return features if targets is None else targets
    return features.join(targets, key, "inner")


def attach_notes(df: DataFrame, notes: DataFrame, row_number: str = "row_number") -> DataFrame:
    """Notes kept beside the data under a 1-based row number."""
    return df.join(notes, row_number, "left")


def shape_summary(df: DataFrame, name: str) -> DataFrame:
    """File name, row count and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns")
    )
