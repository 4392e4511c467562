"""Column profile: one long-format row per column, assembled from three scans.

1. one wide aggregate (a single row per task crosses the network) for counts, moments, dates and coercion;
2. the value-frequency table for distinct counts, top values and shapes;
3. exact quantiles.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.dates import iso, text_to_timestamp, timestamp_of
from siltworks.functions.hashing import seeded_md5
from siltworks.functions.numbers import INFINITY_RE, adjusted_kurtosis, adjusted_skewness, coded_number, number_of, present, text_to_number
from siltworks.functions.strings import signature
from siltworks.operators.frequency import LONG_VALUE, restore_long_values, top_per_column, typed_frequencies, typed_pairs, value_key
from siltworks.operators.heavy import heavy_top
from siltworks.operators.inference import CATEGORICAL, COLUMN_CHUNK, DATETIME, NUMERIC, coercion_failures, failure_flag, inferred_with_length, long_rows, quoted
from siltworks.operators.quantiles import exact_quantiles, sketch_quantiles

# Sentinels and thresholds of the warnings.
SENTINELS = (-1, 0, 999, 9999)
SENTINEL_SHARE = 0.05
HIGH_CARDINALITY, CARDINALITY_ROWS = 0.95, 50
NEAR_CONSTANT, CONSTANT_ROWS = 0.99, 50
HIGH_MISSINGNESS = 0.3
# Extended metrics per type, and how many a column may report.
COMMON_METRICS = ("n_missing", "p_missing", "n_distinct", "p_distinct", "memory_size")
NUMERIC_METRICS = ("std", "variance", "kurtosis", "iqr", "mad")
CATEGORICAL_METRICS = ("n_unique", "p_unique", "max_length", "min_length", "avg_length")
DATETIME_METRICS = ("min", "max", "n_unique", "p_unique")
MAX_METRICS = 20
# Tags of a profile whose extended metrics failed, or were left out of a wide table on request.
FALLBACK_TAG, SKIPPED_TAG = "extended_fallback_to_baseline", "extended_skipped_wide_table"
# Guardrails of the optional sampled mode.
SAMPLE_ABOVE_ROWS, SAMPLE_ROWS = 50_000, 10_000


@dataclass
class ProfileOptions:
    """What a profile computes; the defaults are exact and complete."""

    as_of: dt.date | None = None
    types: dict[str, str] = field(default_factory=dict)
    top_k: int = 5
    samples: int = 5
    seed: int = 42
    heaping_share: float | None = None
    extended: bool = False
    extended_column_limit: int | None = None
    exact: bool = True

    def reference_date(self) -> dt.date:
        return self.as_of or dt.date.today()


def scalar_stats(df: DataFrame, types: dict[str, str], as_of: dt.date) -> DataFrame:
    """Everything one pass over a column can aggregate, one row per column.

    Numbers are aggregated in long form: the plan and its generated code stay the same size for ten or a thousand
    columns, and each task sends one row per column. Dates and texts need few aggregates and go side by side.
    """
    fields = [f for f in df.schema.fields if f.name in types]
    numeric = [f for f in fields if types[f.name] == NUMERIC]
    others = [f for f in fields if types[f.name] != NUMERIC]
    texts = [f for f in numeric if isinstance(f.dataType, T.StringType)]
    parts = []
    if numeric:
        stats = _numeric_stats(df, numeric)
        if texts:
            lengths = _wide_stats(df, texts, types, as_of, lengths_only=True)
            stats = stats.join(F.broadcast(lengths), "column", "left")
        else:
            stats = stats.withColumns({c: F.lit(None) for c in ("max_length", "min_length", "avg_length", "padded_count", "bytes")})
        parts.append(_shaped(stats, numeric, types))
    parts += [_shaped(_wide_stats(df, others[i : i + COLUMN_CHUNK], types, as_of), others, types) for i in range(0, len(others), COLUMN_CHUNK)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _numeric_stats(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    pairs = df.select(*[coded_number(f.name, f.dataType).alias(f.name) for f in fields]).unpivot([], [f.name for f in fields], "column", "v")
    x = F.when(F.abs("v") < F.lit(float("inf")), F.col("v"))
    pairs = pairs.select("column", "v", x.alias("x"))
    x, v = F.col("x"), F.col("v")
    return pairs.groupBy("column").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("v").alias("non_null"),
        F.count("x").alias("finite"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.avg("x").alias("mean"),
        F.skewness("x").alias("skew"),
        F.kurtosis("x").alias("kurt"),
        F.stddev_samp("x").alias("std"),
        F.count_if(x == 0).alias("zero_count"),
        F.count_if(x < 0).alias("negative_count"),
        F.count_if(v.isNotNull() & x.isNull()).alias("inf_nan"),
        F.count_if(F.isnan("v")).alias("failures"),
        F.array(*[F.count_if(x == float(s)) for s in SENTINELS]).alias("sentinel_counts"),
    )


def _wide_stats(df: DataFrame, fields: list[T.StructField], types: dict[str, str], as_of: dt.date, lengths_only: bool = False) -> DataFrame:
    """Counts, dates and text lengths of columns side by side, then one row per column."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    structs = []
    for i, f in enumerate(fields):
        c = quoted(f.name)
        wanted: dict[str, Column] = {}
        if not lengths_only:
            wanted["non_null"] = F.count_if(present(f.name, f.dataType))
            if types[f.name] == DATETIME:
                d = timestamp_of(f.name, f.dataType)
                wanted |= {"parsed": F.count(d), "earliest": F.min(d), "latest": F.max(d), "future": F.count_if(d > F.lit(as_of).cast("timestamp"))}
        if isinstance(f.dataType, T.StringType):
            wanted |= {
                "padded_count": F.count_if(F.trim(c) != c),
                "max_length": F.max(F.length(c)),
                "min_length": F.min(F.length(c)),
                "avg_length": F.avg(F.length(c)),
                "bytes": F.sum(F.octet_length(c)),
            }
        aggs += [v.alias(f"{k}_{i}") for k, v in wanted.items()]
        kept = {"padded_count": "long", "max_length": "long", "min_length": "long", "avg_length": "double", "bytes": "long"}
        if not lengths_only:
            kept |= {"non_null": "long", "parsed": "long", "earliest": "timestamp", "latest": "timestamp", "future": "long"}
        cells = [(F.col(f"{k}_{i}") if k in wanted else F.lit(None)).cast(t).alias(k) for k, t in kept.items()]
        structs.append(F.struct(F.lit(f.name).alias("column"), *([] if lengths_only else [F.col("rows").alias("row_count")]), *cells))
    return long_rows(df.agg(*aggs), structs)


def _shaped(stats: DataFrame, fields: list[T.StructField], types: dict[str, str]) -> DataFrame:
    """Aggregates of either kind in the common layout; what a kind does not have is null."""
    have = set(stats.columns)

    def got(name: str, cast: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(cast)

    def by_column(values: dict[str, object], cast: str) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
        return F.element_at(F.create_map(*pairs), F.col("column")).cast(cast)

    def finite_or_null(c: Column) -> Column:
        return F.when(F.abs(c) < F.lit(float("inf")), c)

    rows, non_null, n = F.col("row_count"), F.col("non_null"), got("finite", "long")
    kind = by_column({f.name: types[f.name] for f in fields}, "string")
    failures = F.coalesce(got("failures", "long"), F.when(kind == DATETIME, non_null - got("parsed", "long")))
    columns = {
        "column": F.col("column"),
        "inferred_type": kind,
        "actual_dtype": by_column({f.name: f.dataType.simpleString() for f in fields}, "string"),
        "type_mismatch": by_column({f.name: isinstance(f.dataType, T.StringType) and types[f.name] != CATEGORICAL for f in fields}, "boolean"),
        "row_count": rows,
        "non_null": non_null,
        "completeness": F.when(rows > 0, non_null / rows).otherwise(F.lit(0.0)),
        "finite_count": n,
        "min": got("min", "double"),
        "max": got("max", "double"),
        "mean": finite_or_null(got("mean", "double")),
        "skewness": adjusted_skewness(got("skew", "double"), n),
        "kurtosis": adjusted_kurtosis(got("kurt", "double"), n),
        "std": finite_or_null(got("std", "double")),
        "zero_count": got("zero_count", "long"),
        "negative_count": got("negative_count", "long"),
        "inf_nan_count": got("inf_nan", "long"),
        "coercion_failure_count": failures,
        "sentinel_counts": got("sentinel_counts", "array<long>"),
        "earliest": iso(got("earliest", "timestamp")),
        "latest": iso(got("latest", "timestamp")),
        "datetime_format_consistency": F.when((kind == DATETIME) & (non_null > 0), got("parsed", "double") / non_null),
        "future_date_count": got("future", "long"),
        "padded_count": got("padded_count", "long"),
        "max_length": got("max_length", "long"),
        "min_length": got("min_length", "long"),
        "avg_length": got("avg_length", "double"),
        "memory_size": F.coalesce(got("bytes", "long"), non_null * by_column({f.name: _width(f.dataType) for f in fields}, "long")),
    }
    return stats.select(*[c.alias(name) for name, c in columns.items()])


def _width(dtype: T.DataType) -> int:
    """Bytes a fixed-width value takes; nested values have no fixed width and count one word."""
    widths = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    return widths.get(type(dtype), 8)


def shape_consistency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Dominant signature of text columns and its share of the non-null values, over whole texts of any length."""
    shapes = df.select(*[value_key(signature(quoted(c))).alias(c) for c in columns])
    counted = shapes.unpivot([], columns, "column", "value").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    lookup = df.select(*[signature(quoted(c)).alias(c) for c in columns])
    return _dominant(counted, lookup)


def _dominant(counted: DataFrame, lookup: DataFrame | None) -> DataFrame:
    totals = counted.groupBy("column").agg(F.sum("n").alias("total"))
    top = top_per_column(counted, 1)
    top = top if lookup is None else restore_long_values(lookup, top)
    return top.join(F.broadcast(totals), "column").select(
        "column", F.col("value").alias("dominant_pattern"), (F.col("n") / F.col("total")).alias("regex_format_consistency")
    )


def _numbers(df: DataFrame, types: dict[str, str]) -> dict[str, Column]:
    return {c: number_of(c, df.schema[c].dataType) for c, t in types.items() if t == NUMERIC}


def quantile_rows(df: DataFrame, types: dict[str, str], exact: bool = True) -> DataFrame:
    """``(column, q1, median, q3)`` of the numeric columns: exact, or read off sketches in one scan."""
    found = (exact_quantiles if exact else sketch_quantiles)(df, _numbers(df, types), (0.25, 0.5, 0.75))
    return df.sparkSession.createDataFrame([(c, *q) for c, q in found.items()], "column string, q1 double, median double, q3 double")


def deviation_rows(df: DataFrame, types: dict[str, str], medians: dict[str, float | None] | None = None, exact: bool = True) -> DataFrame:
    """``(column, mad)``: median absolute deviation from the median, a second quantile pass around the first (or the given one)."""
    values, quantiles = _numbers(df, types), exact_quantiles if exact else sketch_quantiles
    medians = {c: q[0] for c, q in quantiles(df, values, (0.5,)).items()} if medians is None else medians
    around = {c: F.abs(values[c] - F.lit(m)) for c, m in medians.items() if m is not None}
    found = quantiles(df, around, (0.5,))
    return df.sparkSession.createDataFrame([(c, q[0]) for c, q in found.items()], "column string, mad double")


def semantic_warnings(as_of: dt.date, heaping_share: float | None = None, tag: str | None = None) -> Column:
    """The warnings of a profile row as an array, in a fixed order; ``tag`` says why extended metrics are missing."""
    numeric, rows, non_null = F.col("inferred_type") == NUMERIC, F.col("row_count"), F.col("non_null")
    text = F.col("actual_dtype") == "string"
    tags = [
        F.when((F.col("unique_factor") > HIGH_CARDINALITY) & (rows >= CARDINALITY_ROWS), "High Cardinality"),
        F.when((F.col("top_count") / non_null >= NEAR_CONSTANT) & (non_null >= CONSTANT_ROWS), "Near Constant Value"),
        F.when((rows - non_null) / rows >= HIGH_MISSINGNESS, "High Missingness"),
    ]
    for j, s in enumerate(SENTINELS):
        share = F.get("sentinel_counts", F.lit(j)) / F.nullif(F.col("finite_count"), F.lit(0))
        tags.append(F.when(numeric & (share >= SENTINEL_SHARE), f"Possible Sentinel: {s}"))
    tags += [
        F.when(numeric & (F.col("negative_count") > 0), "Contains Negative Values"),
        F.when((F.col("inferred_type") == CATEGORICAL) & text & (F.col("padded_count") > 0), "Leading/Trailing Whitespace"),
        F.when(
            F.col("future_date_count") > 0,
            F.concat(F.lit("Future Dates Detected: "), F.col("future_date_count").cast("string"), F.lit(f" values after {as_of.isoformat()}")),
        ),
    ]
    if heaping_share is not None:
        tags.append(F.when(numeric & (F.col("top_count") / non_null >= heaping_share), "Value Heaping"))
    if tag is not None:
        tags.append(F.lit(tag))
    return F.array_compact(F.array(*tags))


def profile(df: DataFrame, options: ProfileOptions | None = None) -> DataFrame:
    """The whole profile, one row per column in table order (``position``).

    Every frame joined below has at most one row per column of the table, so the joins are broadcasts of that size.
    """
    options = options or ProfileOptions()
    if not df.columns:
        raise ValueError("a profile needs at least one column")
    known = inferred_with_length(df)
    types = {c: options.types.get(c, kind) for c, (kind, _) in known.items()}
    long_texts = {c for c, (_, length) in known.items() if length > LONG_VALUE}
    as_of, spark = options.reference_date(), df.sparkSession

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right), "column", "left")

    out = scalar_stats(df, types, as_of)
    quartiles = quantile_rows(df, types, options.exact)
    out = beside(out, quartiles)
    texts = [c for c, t in types.items() if t == CATEGORICAL and isinstance(df.schema[c].dataType, T.StringType)]
    failing = {c: t for c, t in types.items() if t != CATEGORICAL and isinstance(df.schema[c].dataType, T.StringType)}
    if options.exact:
        frequencies = typed_frequencies(df)
        out = beside(out, _per_column(frequencies))
        shapes = _shapes(df, frequencies, [c for c in texts if c not in long_texts], [c for c in texts if c in long_texts])
        listed = _listed_values(df, frequencies, options, bool(long_texts) or _has_nested(df))
        samples = coercion_failures(df, failing).select("column", F.col("samples").alias("coercion_failure_samples")) if failing else None
    else:
        top = heavy_values(df, options.top_k)
        tops = top.where("rank = 1").select("column", F.col("n").alias("top_count"))
        out = beside(beside(out, approximate_distinct(df)), tops)
        shapes = heavy_shapes(df, texts) if texts else None
        listed = _cheap_lists(df, top, options)
        samples = _cheap_failures(df, failing, options.samples) if failing else None
    out = out.withColumns(
        {
            "unique_count": F.coalesce("unique_count", F.lit(0)),
            "unique_factor": F.when(F.col("row_count") > 0, F.coalesce("unique_count", F.lit(0)) / F.col("row_count")).otherwise(0.0),
        }
    )
    out = beside(out, shapes) if shapes is not None else out.withColumns({"dominant_pattern": F.lit(None).cast("string"), "regex_format_consistency": F.lit(None).cast("double")})
    out = beside(out, listed)
    if samples is not None:
        out = beside(out, samples).withColumn("coercion_failure_samples", F.when(F.col("column").isin(*failing), F.coalesce("coercion_failure_samples", F.lit(""))))
    else:
        out = out.withColumn("coercion_failure_samples", F.lit(None).cast("string"))
    tag = None
    if options.extended and options.extended_column_limit is not None and len(types) > options.extended_column_limit:
        tag = SKIPPED_TAG
    elif options.extended:
        try:
            medians = {r["column"]: r["median"] for r in quartiles.collect()}
            out = beside(out, deviation_rows(df, types, medians, options.exact)).withColumn("metrics", extended_metrics())
        except PySparkException:
            tag = FALLBACK_TAG
    order = F.broadcast(spark.createDataFrame([(c, i) for i, c in enumerate(types)], "column string, position int"))
    return (
        out.join(order, "column")
        .withColumn("warnings", semantic_warnings(as_of, options.heaping_share, tag))
        .drop("sentinel_counts", "padded_count")
    )


def _has_nested(df: DataFrame) -> bool:
    return any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) for f in df.schema.fields)


def _per_column(frequencies: dict[str, DataFrame]) -> DataFrame:
    """Distinct counts, values seen once and the top count, per column."""
    out = None
    for freq in frequencies.values():
        one = freq.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"), F.count_if(F.col("n") == 1).alias("n_unique"), F.max("n").alias("top_count"))
        out = one if out is None else out.unionByName(one)
    return out


def _above(freq: DataFrame, condition: Column) -> DataFrame:
    """Filter a frequency table after its shuffle: tied to the count, the condition stays there, and the shuffle is shared."""
    return freq.where(F.when(F.col("n") > 0, condition))


def _shapes(df: DataFrame, frequencies: dict[str, DataFrame], short: list[str], long: list[str]) -> DataFrame | None:
    """Dominant signatures: of short texts from their distinct values, of long ones from the texts themselves."""
    parts = []
    if short:
        shaped = _above(frequencies["text"], F.col("column").isin(*short)).select("column", signature(F.col("value")).alias("value"), "n")
        parts.append(_dominant(shaped.groupBy("column", "value").agg(F.sum("n").alias("n")), None))
    if long:
        parts.append(shape_consistency(df, long))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _listed_values(df: DataFrame, frequencies: dict[str, DataFrame], options: ProfileOptions, restore: bool) -> DataFrame:
    """Top values and seeded sample values per column, both limited inside each task before the shuffle."""
    few = None
    for kind, freq in frequencies.items():
        top = top_per_column(freq, options.top_k).withColumn("what", F.lit("top"))
        sample = top_per_column(freq, options.samples, [F.xxhash64("value", F.lit(options.seed)).asc(), F.asc("value")]).withColumn("what", F.lit("sample"))
        one = top.unionByName(sample).withColumn("value", F.col("value").cast("string"))
        if kind == "text" and restore:
            one = restore_long_values(df, one)
        one = one.select("column", "what", "rank", "value", "n")
        few = one if few is None else few.unionByName(one)
    return few.groupBy("column").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("what") == "top", F.struct("rank", "value", "n")))),
            lambda s: F.struct(s["value"].alias("value"), s["n"].alias("count")),
        ).alias("top_values"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == "sample", F.struct("rank", "value")))), lambda s: s["value"]).alias("samples"),
    )


def heavy_values(df: DataFrame, k: int) -> DataFrame:
    """``(column, rank, value, n)``: the most frequent values named by sketches, with their exact counts; whole texts.

    A column whose values are all rare has no frequent ones: what the sketch names there are some of its values.
    """
    out = None
    for kind, (_, pairs) in typed_pairs(df).items():
        top = heavy_top(pairs, k).drop("proven").withColumn("value", F.col("value").cast("string"))
        top = restore_long_values(df, top) if kind == "text" else top
        one = top.select("column", "rank", "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def heavy_shapes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Dominant signature and its share, from sketched candidates: signatures are counted, not values."""
    pairs = df.select(*[value_key(signature(quoted(c))).alias(c) for c in columns]).unpivot([], columns, "column", "value").where("value is not null")
    totals = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("total"))
    top = restore_long_values(df.select(*[signature(quoted(c)).alias(c) for c in columns]), heavy_top(pairs, 1).drop("proven"))
    return top.join(F.broadcast(totals), "column").select("column", F.col("value").alias("dominant_pattern"), (F.col("n") / F.col("total")).alias("regex_format_consistency"))


def _one_per_bucket(pairs: DataFrame, k: int, seed: int, least: Column) -> DataFrame:
    """At most ``k`` different values per column: of each of ``k`` seeded hash buckets the first in order of ``least``.

    An aggregate: a task sends ``k`` values per column, whatever it read.
    """
    bucket = F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(k)).alias("bucket")
    return pairs.groupBy("column", bucket).agg(F.min_by("value", F.struct(least, F.col("value"))).alias("value"))


def _cheap_lists(df: DataFrame, top: DataFrame, options: ProfileOptions) -> DataFrame:
    """Top values and sample values per column without a frequency table."""
    samples = None
    for kind, (_, pairs) in typed_pairs(df).items():
        few = _one_per_bucket(pairs, options.samples, options.seed, F.xxhash64("value", F.lit(options.seed + 1))).withColumn("value", F.col("value").cast("string"))
        few = restore_long_values(df, few) if kind == "text" else few
        one = few.select("column", "value")
        samples = one if samples is None else samples.unionByName(one)
    listed = samples.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    entries = top.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
    told = entries.select("column", F.transform("t", lambda s: F.struct(s["value"].alias("value"), s["n"].alias("count"))).alias("top_values"))
    return told.join(F.broadcast(listed), "column", "left")


def _cheap_failures(df: DataFrame, failing: dict[str, str], k: int) -> DataFrame:
    """Up to ``k`` different texts per column that do not read as its type: the smallest of each hash bucket."""
    bad = df.select(*[F.when(failure_flag(df, c, t), quoted(c)).alias(c) for c, t in failing.items()]).unpivot([], list(failing), "column", "value").where("value is not null")
    few = _one_per_bucket(bad, k, 0, F.lit(0))
    return few.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("coercion_failure_samples"))


def approximate_distinct(df: DataFrame, relative_error: float = 0.02) -> DataFrame:
    """Sketch-based distinct counts in one pass; the count of values seen once needs all values and is null."""
    structs = [
        F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("unique_count"), F.lit(None).cast("long").alias("n_unique"))
        for i, c in enumerate(df.columns)
    ]
    return long_rows(df.agg(*[F.approx_count_distinct(quoted(c), relative_error).alias(f"d{i}") for i, c in enumerate(df.columns)]), structs)


def extended_metrics() -> Column:
    """Whitelisted metrics of a profile row as a map of text, by type, at most ``MAX_METRICS``."""
    rows = F.col("row_count")
    values = {
        "n_missing": (rows - F.col("non_null")),
        "p_missing": (rows - F.col("non_null")) / rows,
        "n_distinct": F.col("unique_count"),
        "p_distinct": F.col("unique_count") / F.nullif(F.col("non_null"), F.lit(0)),
        "memory_size": F.col("memory_size"),
        "std": F.col("std"),
        "variance": F.col("std") * F.col("std"),
        "kurtosis": F.col("kurtosis"),
        "iqr": F.col("q3") - F.col("q1"),
        "mad": F.col("mad"),
        "n_unique": F.col("n_unique"),
        "p_unique": F.col("n_unique") / F.nullif(F.col("non_null"), F.lit(0)),
        "max_length": F.col("max_length"),
        "min_length": F.col("min_length"),
        "avg_length": F.col("avg_length"),
        "min": F.col("earliest"),
        "max": F.col("latest"),
    }

    def pick(names: tuple[str, ...]) -> Column:
        entries = [F.struct(F.lit(n).alias("key"), values[n].cast("string").alias("value")) for n in (COMMON_METRICS + names)[:MAX_METRICS]]
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))

    return (
        F.when(F.col("inferred_type") == NUMERIC, pick(NUMERIC_METRICS))
        .when(F.col("inferred_type") == DATETIME, pick(DATETIME_METRICS))
        .otherwise(pick(CATEGORICAL_METRICS))
    )


def sampled(df: DataFrame, key: str, rows: int = SAMPLE_ROWS, above: int = SAMPLE_ABOVE_ROWS, seed: int = 42) -> DataFrame:
    """A fixed-size sample by seeded digest for tables above a size; smaller tables stay whole. An option, never a default."""
    if df.agg(F.count(F.lit(1))).first()[0] <= above:
        return df
    return df.orderBy(seeded_md5(quoted(key), seed), quoted(key)).limit(rows)


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Before and after a pass, one row per column of either table."""
    keep = ["column", "inferred_type", "row_count", "completeness", "unique_count", "inf_nan_count", F.size("warnings").alias("warning_count")]
    a, b = before.select(*keep), after.select(*keep)
    names = [c for c in a.columns if c != "column"]
    a = a.select("column", *[F.col(c).alias(f"{c}_before") for c in names])
    b = b.select("column", *[F.col(c).alias(f"{c}_after") for c in names])
    return a.join(b, "column", "full_outer").withColumn(
        "change",
        F.when(F.col("row_count_before").isNull(), "added").when(F.col("row_count_after").isNull(), "removed").otherwise("kept"),
    )


def profile_summary(profile_rows: DataFrame) -> DataFrame:
    """Only the columns with warnings, beside the size of the table."""
    size = profile_rows.agg(F.max("row_count").alias("rows"), F.count(F.lit(1)).alias("columns")).first()
    return profile_rows.where(F.size("warnings") > 0).select(
        F.lit(size["rows"]).cast("long").alias("rows"), F.lit(size["columns"]).cast("long").alias("columns"), "column", F.array_join("warnings", "; ").alias("warnings")
    )
