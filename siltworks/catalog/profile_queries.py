"""Column profile, warnings and quality scores (families C, D and E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.catalog.registry import Family
from siltworks.catalog.source_queries import date_sql, number_sql
from siltworks.catalog.views import AS_OF, ctes, table, view
from siltworks.functions.strings import signature
from siltworks.operators import frequency as fq
from siltworks.operators import heavy as hv
from siltworks.operators import profiling as pr
from siltworks.operators import quality as ql
from siltworks.operators.inference import inferred_map
from siltworks.plans.recipe import Step, replay

family = Family()
QUERIES, ORACLES = family.queries, family.oracles
query = family.query

LINEITEM_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINEITEM_COLUMNS = (*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate")
DIRTY = ("o_orderkey", "o_custkey", "amount", "amount_s", "order_date_s", "priority", "status", "email")
DIRTY_TYPES = {
    "o_orderkey": "Numeric",
    "o_custkey": "Numeric",
    "amount": "Numeric",
    "amount_s": "Numeric",
    "order_date_s": "Datetime",
    "priority": "Categorical",
    "status": "Categorical",
    "email": "Categorical",
}
FINITE_AMOUNT = "case when isfinite(amount) then amount end"
DIRTY_VALUE = {"amount": FINITE_AMOUNT, "amount_s": number_sql("amount_s"), "o_orderkey": "cast(o_orderkey as double)", "o_custkey": "cast(o_custkey as double)"}


def options(**extra) -> pr.ProfileOptions:
    return pr.ProfileOptions(as_of=AS_OF, **extra)


def each(columns, template: str, source: str) -> str:
    """One select per column, put together; ``{c}`` is the column."""
    return " union all ".join(f"select '{c}' as \"column\", {template.replace('{c}', c)} from {source}" for c in columns)


@query(
    each(
        LINEITEM_COLUMNS,
        "count(*) as row_count, count({c}) as non_null, count({c}) * 1.0::double / count(*) as completeness, count(distinct {c}) as unique_count, "
        "round(count(distinct {c}) * 1.0::double / count(*), 9) as unique_factor",
        "lineitem",
    )
)
def profile_counts(spark, sf) -> DataFrame:
    df = pr.profile(table(spark, sf, "lineitem"), options())
    return df.select("column", "row_count", "non_null", "completeness", "unique_count", F.round("unique_factor", 9).alias("unique_factor"))


@query(
    " union all ".join(
        f"select '{c}' as \"column\", min(x) as min, max(x) as max, round(avg(x), 4) as mean, round(skewness(x), 6) as skewness, round(quantile_cont(x, 0.5), 4) as median, "
        f"round(quantile_cont(x, 0.25), 4) as q1, round(quantile_cont(x, 0.75), 4) as q3 from (select cast({c} as double) as x from lineitem)"
        for c in LINEITEM_NUMBERS
    )
)
def profile_moments(spark, sf) -> DataFrame:
    df = pr.profile(table(spark, sf, "lineitem"), options()).where("inferred_type = 'Numeric'")
    return df.select(
        "column",
        "min",
        "max",
        F.round("mean", 4).alias("mean"),
        F.round("skewness", 6).alias("skewness"),
        *[F.round(c, 4).alias(c) for c in ("median", "q1", "q3")],
    )


@query(
    f"{ctes('orders_dirty')} "
    + " union all ".join(
        f"""select '{c}' as "column", count(*) filter (where x = 0) as zero_count, count(*) filter (where x < 0) as negative_count,
 count(*) filter (where {c} is not null and x is null) as inf_nan_count, min(x) as min, max(x) as max, round(avg(x), 4) as mean, round(quantile_cont(x, 0.5), 4) as median
 from (select {c}, {DIRTY_VALUE[c]} as x from orders_dirty)"""
        for c in ("amount", "amount_s", "o_orderkey", "o_custkey")
    )
)
def profile_dirty_numbers(spark, sf) -> DataFrame:
    df = pr.profile(view(spark, sf, "orders_dirty"), options()).where("inferred_type = 'Numeric'")
    return df.select("column", "zero_count", "negative_count", "inf_nan_count", "min", "max", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


@query(
    f"""{ctes('orders_dirty')} select 'order_date_s' as "column", strftime(min(d), '%Y-%m-%dT%H:%M:%S') as earliest, strftime(max(d), '%Y-%m-%dT%H:%M:%S') as latest,
 round(count(d) * 1.0::double / count(order_date_s), 9) as datetime_format_consistency, count(*) filter (where d > timestamp '{AS_OF}') as future_date_count,
 count(order_date_s) - count(d) as coercion_failure_count from (select order_date_s, {date_sql('order_date_s')} as d from orders_dirty)"""
)
def profile_dates(spark, sf) -> DataFrame:
    df = pr.scalar_stats(view(spark, sf, "orders_dirty"), {"order_date_s": "Datetime"}, AS_OF)
    return df.select(
        "column", "earliest", "latest", F.round("datetime_format_consistency", 9).alias("datetime_format_consistency"), "future_date_count", "coercion_failure_count"
    )


@query(
    """with v as (select 'o_orderstatus' as "column", o_orderstatus as value, 0 as place, count(*) as n from orders group by 2
 union all select 'o_orderpriority', o_orderpriority, 0, count(*) from orders group by 2
 union all select 'o_custkey', cast(o_custkey as varchar), o_custkey, count(*) from orders group by o_custkey),
 r as (select *, row_number() over (partition by "column" order by n desc, place, value) as rank from v)
 select "column", cast(rank as integer) as rank, value, n from r where rank <= 5"""
)
def top_values(spark, sf) -> DataFrame:
    return fq.top_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], 5)


@query(
    """with r as (select text as value, count(*) as n, row_number() over (order by count(*) desc, text) as rank
 from documents group by text) select cast(rank as integer) as rank, value, n from r where rank <= 5"""
)
def top_long_texts(spark, sf) -> DataFrame:
    """Long values travel as their beginning and a digest, and come back whole; ties go by the text."""
    return fq.top_values(table(spark, sf, "documents"), ["text"], 5).select("rank", "value", "n")


@query(
    """with v as (select 'event_type' as "column", event_type as value, event_type as place, count(*) as n from events group by 2 union all select 'props', props, props, count(*) from events group by 2
 union all select 'user_id', cast(user_id as varchar), lpad(cast(user_id as varchar), 20, '0'), count(*) from events group by user_id union all select 'event_id', cast(event_id as varchar), lpad(cast(event_id as varchar), 20, '0'), count(*) from events group by event_id),
 r as (select *, row_number() over (partition by "column" order by n desc, place) as rank from v)
 select "column", cast(rank as integer) as rank, value, n from r where rank <= 5"""
)
def heavy_hitters(spark, sf) -> DataFrame:
    """Frequent values from sketched candidates and one recount; only the column without frequent values is counted in full."""
    return hv.top_values_by_recount(table(spark, sf, "events"), ["event_type", "props", "user_id", "event_id"], 5)


@query(
    """with p as (select md5(cast(o_orderkey as varchar) || '42') as digest, o_orderstatus, o_orderpriority, cast(o_custkey as varchar) as o_custkey from orders),
 u as (select 'o_orderstatus' as "column", digest, o_orderstatus as value from p union all select 'o_orderpriority', digest, o_orderpriority from p union all select 'o_custkey', digest, o_custkey from p),
 r as (select "column", value, row_number() over (partition by "column" order by digest, value) as rank from u)
 select "column", cast(rank as integer) as rank, value from r where rank <= 5"""
)
def sample_values(spark, sf) -> DataFrame:
    return fq.sample_values(table(spark, sf, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(
    f"""{ctes('orders_dirty')}, d as (select distinct order_date_s as value from orders_dirty),
 r as (select value, row_number() over (order by md5(value || '42'), value) as rank from d) select cast(rank as integer) as rank, value from r where rank <= 5"""
)
def datetime_format_samples(spark, sf) -> DataFrame:
    """Distinct raw date texts, chosen by seeded digest."""
    freq = fq.value_frequency(view(spark, sf, "orders_dirty"), ["order_date_s"])
    from siltworks.functions.hashing import seeded_md5

    return fq.top_per_column(freq, 5, [seeded_md5(F.col("value"), 42).asc(), F.asc("value")]).select("rank", "value")


SQL_SIGNATURE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[^\p{L}\p{Nd}\s]', '.', 'g'), '\p{Nd}', '9', 'g'), '\p{L}', 'A', 'g'), '\s', '_', 'g')"


@query(f"{ctes('orders_dirty')} select s as signature, count(*) as n from (select {SQL_SIGNATURE.replace('{c}', 'priority')} as s from orders_dirty where priority is not null) group by s")
def pattern_signatures(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty").where("priority is not null")
    return df.groupBy(signature(F.col("priority")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select lang, count(*) as n, cast(sum(length(regexp_replace(s, '[^A]', '', 'g'))) as bigint) as letters, cast(sum(length(regexp_replace(s, '[^_]', '', 'g'))) as bigint) as spaces from (select lang, {SQL_SIGNATURE.replace('{c}', 'text')} as s from documents) group by lang")
def text_signatures(spark, sf) -> DataFrame:
    df = table(spark, sf, "documents").select("lang", signature(F.col("text")).alias("s"))
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length(F.regexp_replace("s", "[^A]", ""))).alias("letters"),
        F.sum(F.length(F.regexp_replace("s", "[^_]", ""))).alias("spaces"),
    )


@query(
    f"{ctes('orders_dirty')}, s as ("
    + " union all ".join(f"select '{c}' as \"column\", {SQL_SIGNATURE.replace('{c}', c)} as sig from orders_dirty where {c} is not null" for c in ("priority", "status", "email"))
    + """), g as (select "column", sig, count(*) as n from s group by all), r as (select *, row_number() over (partition by "column" order by n desc, sig) as rn, sum(n) over (partition by "column") as total from g)
 select "column", sig as dominant_pattern, round(n * 1.0::double / total, 9) as regex_format_consistency from r where rn = 1"""
)
def dominant_patterns(spark, sf) -> DataFrame:
    df = pr.shape_consistency(view(spark, sf, "orders_dirty"), ["priority", "status", "email"])
    return df.select("column", "dominant_pattern", F.round("regex_format_consistency", 9).alias("regex_format_consistency"))


@query(
    " union all ".join(
        f"""select '{c}' as "column", round(stddev_samp(x), 4) as std, round(var_samp(x), 2) as variance, round(kurtosis(x), 6) as kurtosis,
 round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) as iqr, round(mad(x), 4) as mad from (select cast({c} as double) as x from lineitem)"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    )
)
def extended_numeric(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    types = inferred_map(df)
    stats = pr.scalar_stats(df, types, AS_OF).join(pr.quantile_rows(df, types), "column").join(pr.deviation_rows(df, types), "column")
    return stats.select(
        "column",
        F.round("std", 4).alias("std"),
        F.round(F.col("std") * F.col("std"), 2).alias("variance"),
        F.round("kurtosis", 6).alias("kurtosis"),
        F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"),
        F.round("mad", 4).alias("mad"),
    )


@query(
    f"{ctes('documents_labelled')} "
    + " union all ".join(
        f"""select '{c}' as "column", count(*) - count({c}) as n_missing, round((count(*) - count({c})) * 1.0::double / count(*), 9) as p_missing,
 count(distinct {c}) as n_distinct, round(count(distinct {c}) * 1.0::double / nullif(count({c}), 0), 9) as p_distinct, cast({size} as bigint) as memory_size from documents_labelled"""
        for c, size in (("doc_id", "count(doc_id) * 8"), ("lang", "sum(strlen(lang))"), ("text", "sum(strlen(text))"), ("n_chars", "count(n_chars) * 8"), ("quality", "count(quality) * 4"), ("toxic", "count(toxic) * 4"))
    )
)
def extended_common(spark, sf) -> DataFrame:
    df = view(spark, sf, "documents_labelled").drop("source")
    stats = pr.scalar_stats(df, inferred_map(df), AS_OF).join(fq.frequency_stats(fq.value_frequency(df)).drop("non_null"), "column")
    missing = F.col("row_count") - F.col("non_null")
    return stats.select(
        "column",
        missing.alias("n_missing"),
        F.round(missing / F.col("row_count"), 9).alias("p_missing"),
        F.col("unique_count").alias("n_distinct"),
        F.round(F.col("unique_count") / F.col("non_null"), 9).alias("p_distinct"),
        "memory_size",
    )


@query(
    " union all ".join(
        f"""select '{c}' as "column", (select count(*) from (select {c} from customer group by {c} having count(*) = 1)) as n_unique,
 cast(max(length({c})) as bigint) as max_length, cast(min(length({c})) as bigint) as min_length, round(avg(length({c})), 6) as avg_length from customer"""
        for c in ("c_name", "c_mktsegment")
    )
)
def extended_categorical(spark, sf) -> DataFrame:
    df = table(spark, sf, "customer").select("c_name", "c_mktsegment")
    stats = pr.scalar_stats(df, inferred_map(df), AS_OF).join(fq.frequency_stats(fq.value_frequency(df)).drop("non_null"), "column")
    return stats.select("column", "n_unique", "max_length", "min_length", F.round("avg_length", 6).alias("avg_length"))


@query(
    """select 'o_orderdate' as "column", strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') as min, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') as max,
 (select count(*) from (select o_orderdate from orders group by 1 having count(*) = 1)) as n_unique from orders"""
)
def extended_datetime(spark, sf) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderdate")
    stats = pr.scalar_stats(df, inferred_map(df), AS_OF).join(fq.frequency_stats(fq.value_frequency(df)).drop("non_null"), "column")
    return stats.select("column", F.col("earliest").alias("min"), F.col("latest").alias("max"), "n_unique")


def _metric_names(names: tuple[str, ...], drop: tuple[str, ...] = ()) -> str:
    return ", ".join(f"'{n}'" for n in pr.COMMON_METRICS + names if n not in drop)


@query(
    f"""select 'c_custkey' as "column", unnest([{_metric_names(pr.NUMERIC_METRICS)}]) as metric union all select 'c_acctbal', unnest([{_metric_names(pr.NUMERIC_METRICS)}])
 union all select 'c_nationkey', unnest([{_metric_names(pr.NUMERIC_METRICS)}]) union all select 'c_name', unnest([{_metric_names(pr.CATEGORICAL_METRICS)}])
 union all select 'c_mktsegment', unnest([{_metric_names(pr.CATEGORICAL_METRICS)}])"""
)
def metric_whitelist(spark, sf) -> DataFrame:
    df = pr.profile(table(spark, sf, "customer"), options(extended=True))
    return df.select("column", F.explode(F.map_keys("metrics")).alias("metric"))


@query("select l_orderkey, l_linenumber, k from (select l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as k from lineitem) order by md5(k || '42'), k limit 10000")
def profile_sample_mode(spark, sf) -> DataFrame:
    """The optional sampled mode: above 50,000 rows a seeded sample of 10,000."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"))
    return pr.sampled(df, "k")


_WARN = f"""{ctes('orders_dirty')}, b as ({" union all ".join(
    f'''select '{c}' as "column", '{t}' as kind, count(*) as rows, count({c}) as non_null, count(distinct {c}) as uniq,
 (select max(n) from (select count(*) as n from orders_dirty where {c} is not null group by {c})) as top_n,
 count({DIRTY_VALUE.get(c, 'null')}) as fin, {", ".join(f"count(*) filter (where {DIRTY_VALUE.get(c, 'null')} = {s}) as s{i}" for i, s in enumerate(pr.SENTINELS))},
 count(*) filter (where {DIRTY_VALUE.get(c, 'null')} < 0) as neg,
 {f"count(*) filter (where trim({c}) <> {c})" if t == 'Categorical' else '0'} as padded,
 {f"count(*) filter (where {date_sql(c)} > timestamp '{AS_OF}')" if t == 'Datetime' else '0'} as future from orders_dirty'''
    for c, t in DIRTY_TYPES.items()
)}),
 w as (select "column", [case when uniq * 1.0 / rows > 0.95 and rows >= 50 then 'High Cardinality' end, case when top_n * 1.0 / non_null >= 0.99 and non_null >= 50 then 'Near Constant Value' end,
 case when (rows - non_null) * 1.0 / rows >= 0.3 then 'High Missingness' end,
 {", ".join(f"case when kind = 'Numeric' and s{i} * 1.0 / fin >= 0.05 then 'Possible Sentinel: {s}' end" for i, s in enumerate(pr.SENTINELS))},
 case when kind = 'Numeric' and neg > 0 then 'Contains Negative Values' end, case when padded > 0 then 'Leading/Trailing Whitespace' end,
 case when future > 0 then 'Future Dates Detected: ' || future || ' values after {AS_OF}' end] as tags from b)
 select "column", warning from (select "column", unnest(tags) as warning from w) where warning is not null"""


@query(_WARN)
def semantic_warnings(spark, sf) -> DataFrame:
    df = pr.profile(view(spark, sf, "orders_dirty"), options())
    return df.select("column", F.explode("warnings").alias("warning"))


@query(
    f"""{ctes('documents_labelled')} select c as "column", 'High Missingness' as warning from (values ('quality'), ('toxic')) t(c)
 where (select (count(*) - count(quality)) * 1.0 / count(*) from documents_labelled) >= 0.3"""
)
def missingness_warnings(spark, sf) -> DataFrame:
    df = pr.profile(view(spark, sf, "documents_labelled").select("doc_id", "lang", "quality", "toxic"), options())
    return df.select("column", F.explode("warnings").alias("warning")).where("warning = 'High Missingness'")


@query(
    """select 'ts' as "column", count(distinct ts) as unique_count, replace(cast(min(ts) as varchar), ' ', 'T') as earliest, replace(cast(max(ts) as varchar), ' ', 'T') as latest from events"""
)
def profile_exact_times(spark, sf) -> DataFrame:
    """Times that differ by microseconds are different values."""
    df = pr.profile(table(spark, sf, "events").select("ts"), options())
    return df.select("column", "unique_count", "earliest", "latest")


@query(
    " union all ".join(
        f"""select '{c}' as "column", 'Value Heaping' as warning from (select max(n) * 1.0 / sum(n) as s from (select count(*) as n from customer group by {c})) where s >= 0.03"""
        for c in ("c_nationkey", "c_acctbal")
    )
)
def heaping_warnings(spark, sf) -> DataFrame:
    """Heaping is an opt-in share of the most frequent value of a numeric column."""
    df = pr.profile(table(spark, sf, "customer").select("c_nationkey", "c_acctbal"), options(heaping_share=0.03))
    return df.select("column", F.explode("warnings").alias("warning")).where("warning = 'Value Heaping'")


@query(f"select \"column\", string_agg(warning, '; ' order by pos) as warnings, (select count(*) from orders) as rows, cast(8 as bigint) as columns from (select \"column\", warning, row_number() over () as pos from ({_WARN})) group by 1")
def profile_summary(spark, sf) -> DataFrame:
    return pr.profile_summary(pr.profile(view(spark, sf, "orders_dirty"), options())).select("column", "warnings", "rows", "columns")


@query(
    " union all ".join(
        f"select '{c}' as \"column\", count(*) as row_count, count({c}) as non_null, 'extended_skipped_wide_table' as warning, false as extended from orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    )
)
def extended_fallback(spark, sf) -> DataFrame:
    """A table with more columns than the extended part was allowed: the base profile of each column, tagged, and no extended metrics."""
    df = pr.profile(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), options(extended=True, extended_column_limit=5))
    tagged = df.withColumn("warning", F.explode("warnings")).where(F.col("warning").startswith("extended_"))
    return tagged.select("column", "row_count", "non_null", "warning", F.lit("metrics" in df.columns).alias("extended"))


_SCORE = f"""{ctes('orders_dirty')}, p as ({" union all ".join(
    f'''select {i} as position, '{c}' as "column", '{t}' as kind, count(*) as rows, count({c}) * 1.0::double / count(*) as completeness,
 {f"count(*) filter (where {c} is not null and {DIRTY_VALUE[c]} is null)" if t == 'Numeric' else '0'} as bad,
 {" * ".join(f"(case when count(*) filter (where {DIRTY_VALUE[c]} = {s}) * 1.0 / count({DIRTY_VALUE[c]}) >= 0.05 then 0.7::double else 1.0::double end)" for s in pr.SENTINELS) if t == 'Numeric' else 'null::double'} as plaus from orders_dirty'''
    for i, (c, t) in enumerate(DIRTY_TYPES.items())
)}),
 m as (select max(rows) as rows, avg(completeness) as completeness, (count(*) filter (where kind = 'Numeric' and bad = 0)) * 1.0::double / count(*) filter (where kind = 'Numeric') as integrity,
 avg(plaus) as plaus, string_agg("column", ', ' order by position) filter (where bad > 0) as bad_columns,
 max(completeness) filter (where "column" = 'amount') as tc, max(bad) filter (where "column" = 'amount') as tb from p)"""


@query(
    _SCORE
    + """ select round(round(0.45 * (tc * (1 - least(tb * 1.0::double / rows, 1.0::double))) + 0.30 * plaus + 0.25 * integrity, 9), 3) as overall, round(round(completeness, 9), 3) as completeness,
 round(round(tc * (1 - least(tb * 1.0::double / rows, 1.0::double)), 9), 3) as target_integrity, round(round(plaus, 9), 3) as value_plausibility, round(round(integrity, 9), 3) as structural_integrity,
 'inf_nan_present: ' || bad_columns || '; target_inf_nan: amount has ' || tb || ' inf/nan values' as flags from m"""
)
def quality_score(spark, sf) -> DataFrame:
    return ql.quality_score(pr.profile(view(spark, sf, "orders_dirty"), options()), "amount")


@query(_SCORE + " select round(round(0.55 * plaus + 0.45 * integrity, 9), 3) as overall, round(round(plaus, 9), 3) as value_plausibility, round(round(integrity, 9), 3) as structural_integrity from m")
def quality_score_without_target(spark, sf) -> DataFrame:
    return ql.quality_score(pr.profile(view(spark, sf, "orders_dirty"), options())).select("overall", "value_plausibility", "structural_integrity")


@query(
    _SCORE
    + """ select round(round(integrity * (1 - 0.5 * least(tb * 1.0::double / rows, 1.0::double)), 9), 3) as structural_score, round(round(completeness, 9), 3) as completeness,
 'inf_nan_present: ' || bad_columns || '; target_inf_nan: amount has ' || tb || ' inf/nan values' as flags from m"""
)
def structural_score(spark, sf) -> DataFrame:
    return ql.structural_score(pr.profile(view(spark, sf, "orders_dirty"), options()), "amount")


@query(_SCORE + " select round(completeness, 9) as completeness, round(integrity, 9) as structural_integrity, bad_columns as dirty_columns, cast(rows as bigint) as row_count from m")
def quality_base_metrics(spark, sf) -> DataFrame:
    base = ql.base_metrics(pr.profile(view(spark, sf, "orders_dirty"), options()))
    return base.select(F.round("completeness", 9).alias("completeness"), F.round("structural_integrity", 9).alias("structural_integrity"), "dirty_columns", "row_count")


@query(
    " union all ".join(
        f"""select '{c}' as "column", (select count(*) from orders) as row_count, (select count({c}) from orders) as non_null, true as near_distinct, true as near_quartiles,
 (select cast({c} as varchar) from orders group by {c} order by count(*) desc, {c} limit 1) as top_value, (select max(n) from (select count(*) as n from orders group by {c})) as top_count"""
        for c in ("o_orderstatus", "o_orderpriority")
    )
    + """ union all select 'o_totalprice', count(*), count(o_totalprice), true, true, null, null from orders"""
)
def cheap_profile(spark, sf) -> DataFrame:
    """The profile on request that shuffles no values: sketches, then exact counts of what they name; held against the exact one."""
    df = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    names = ["column", "unique_count", "q1", "median", "q3", "min", "max"]
    exact = pr.profile(df, options()).select("column", *[F.col(c).alias(f"exact_{c}") for c in names[1:]])
    both = pr.profile(df, options(exact=False)).join(F.broadcast(exact), "column")
    near = F.abs(F.col("unique_count") - F.col("exact_unique_count")) <= 0.1 * F.col("exact_unique_count") + 2
    width = F.col("max") - F.col("min")
    close = [F.coalesce(F.abs(F.col(q) - F.col(f"exact_{q}")) <= 0.05 * width, F.col("column") != "o_totalprice") for q in ("q1", "median", "q3")]
    frequent = F.col("column") != "o_totalprice"
    top = F.col("top_values")[0]
    return both.select(
        "column", "row_count", "non_null", near.alias("near_distinct"), (close[0] & close[1] & close[2]).alias("near_quartiles"),
        F.when(frequent, top["value"]).alias("top_value"), F.when(frequent, top["count"]).alias("top_count"),
    )


CLEANING = [
    Step(1, "DROP_COLUMN", "drop_columns", "email"),
    Step(2, "CUSTOM_CODE", "extract_units", "amount_s"),
    Step(3, "CAST_TYPE", "cast", "order_date_s", {"to": "timestamp"}),
    Step(4, "CUSTOM_CODE", "null_sentinels", "amount", {"values": [-1.0, 9999.0]}),
    Step(5, "CUSTOM_CODE", "null_non_finite", "amount"),
    Step(6, "DROP_ROWS", "drop_missing_target", "amount"),
]


@query(
    f"""{ctes('orders_dirty')}, a as (select case when amount not in (-1, 9999) and isfinite(amount) then amount end as x, * from orders_dirty), k as (select * from a where x is not null)
 select 'amount' as "column", 'kept' as change, (select count(*) from orders_dirty) as row_count_before, (select count(*) from k) as row_count_after,
 (select round(count(amount) * 1.0::double / count(*), 9) from orders_dirty) as completeness_before, 1.0::double as completeness_after
 union all select 'email', 'removed', (select count(*) from orders_dirty), null, 1.0::double, null
 union all select 'status', 'kept', (select count(*) from orders_dirty), (select count(*) from k), 1.0::double, 1.0::double"""
)
def profile_comparison(spark, sf) -> DataFrame:
    """Profile before and after a cleaning pass, side by side."""
    keep = ["amount", "status", "email"]
    before = view(spark, sf, "orders_dirty")
    after = replay(CLEANING, before, "amount").select("amount", "status")
    both = pr.compare_profiles(pr.profile(before.select(*keep), options()), pr.profile(after, options()))
    return both.select(
        "column", "change", "row_count_before", "row_count_after", F.round("completeness_before", 9).alias("completeness_before"), F.round("completeness_after", 9).alias("completeness_after")
    )


@query(
    " union all ".join(
        f"""select '{c}' as "column", '{t}' as inferred_type, {"null::double" if t != 'Numeric' else f"(select round(avg({c}), 4) from lineitem)"} as mean,
 (select count(distinct {c}) from lineitem) as unique_count, (select count(*) from lineitem) as row_count, (select count({c}) from lineitem) as non_null,
 {"null::double" if t != 'Numeric' else f"(select round(quantile_cont(cast({c} as double), 0.5), 4) from lineitem)"} as median,
 (select {{v}} from lineitem group by {c} order by count(*) desc, {{v}} limit 1) as top_value""".replace("{v}", f"strftime({c}, '%Y-%m-%dT%H:%M:%S')" if c == "l_shipdate" else f"cast({c} as varchar)")
        for c, t in [(c, "Numeric") for c in LINEITEM_NUMBERS if c not in ("l_extendedprice", "l_orderkey")] + [("l_returnflag", "Categorical"), ("l_linestatus", "Categorical"), ("l_shipdate", "Datetime")]
    )
)
def full_profile(spark, sf) -> DataFrame:
    """The whole profile of a table, reduced to a handful of its fields for comparison."""
    df = pr.profile(table(spark, sf, "lineitem"), options()).where("column not in ('l_extendedprice', 'l_orderkey')")
    return df.select(
        "column", "inferred_type", F.round("mean", 4).alias("mean"), "unique_count", "row_count", "non_null", F.round("median", 4).alias("median"), F.col("top_values")[0]["value"].alias("top_value")
    )
