"""Feature engineering (family J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.catalog.cleaning_queries import FOLD_SQL
from siltworks.catalog.registry import Family
from siltworks.catalog.views import AS_OF, ctes, table, view
from siltworks.operators import features as fx
from siltworks.operators import profiling as pr
from siltworks.operators.splitting import three_way_split
from siltworks.plans import feature_rounds as fr
from siltworks.plans.feature_rounds import FeatureStep

family = Family()
QUERIES, ORACLES = family.queries, family.oracles
query = family.query


def add(df: DataFrame, *steps: FeatureStep) -> DataFrame:
    return fr.replay_features(list(steps), df)


KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    f"""select {KEY}, round(ln(1 + l_extendedprice), 6) as price_log1p, round(sqrt(l_quantity), 6) as quantity_sqrt, round(l_quantity * l_quantity, 6) as quantity_power,
 abs(l_tax - 0.04) as tax_abs, round(1 / nullif(l_discount, 0), 6) as discount_reciprocal from lineitem""".replace("abs(l_tax - 0.04) as tax_abs", "abs(l_tax) as tax_abs")
)
def numeric_transforms(spark, sf) -> DataFrame:
    df = add(
        table(spark, sf, "lineitem"),
        FeatureStep("price_log1p", "NUMERIC_TRANSFORM", ("l_extendedprice",), {"kind": "log1p"}),
        FeatureStep("quantity_sqrt", "NUMERIC_TRANSFORM", ("l_quantity",), {"kind": "sqrt"}),
        FeatureStep("quantity_power", "NUMERIC_TRANSFORM", ("l_quantity",), {"kind": "power"}),
        FeatureStep("tax_abs", "NUMERIC_TRANSFORM", ("l_tax",), {"kind": "abs"}),
        FeatureStep("discount_reciprocal", "NUMERIC_TRANSFORM", ("l_discount",), {"kind": "reciprocal"}),
    )
    keep = [c for c in df.columns if c in KEY.split(", ") or c == "tax_abs"]
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in ("price_log1p", "quantity_sqrt", "quantity_power", "discount_reciprocal")])


@query(f"select {KEY}, round(l_extendedprice / nullif(l_discount, 0), 4) as ratio, round(l_discount - l_tax, 6) as difference, round(l_extendedprice * l_discount, 4) as product, round(l_discount + l_tax, 6) as total from lineitem")
def interactions(spark, sf) -> DataFrame:
    df = add(
        table(spark, sf, "lineitem"),
        FeatureStep("ratio", "INTERACTION", ("l_extendedprice", "l_discount"), {"kind": "ratio"}),
        FeatureStep("difference", "INTERACTION", ("l_discount", "l_tax"), {"kind": "difference"}),
        FeatureStep("product", "INTERACTION", ("l_extendedprice", "l_discount"), {"kind": "product"}),
        FeatureStep("total", "INTERACTION", ("l_discount", "l_tax"), {"kind": "sum"}),
    )
    return df.select(*KEY.split(", "), *[F.round(c, d).alias(c) for c, d in (("ratio", 4), ("difference", 6), ("product", 4), ("total", 6))])


@query(f"select {KEY}, case when l_quantity > 5 and l_quantity <= 15 then 'small' when l_quantity > 15 and l_quantity <= 30 then 'medium' when l_quantity > 30 and l_quantity <= 45 then 'large' end as size from lineitem")
def binning(spark, sf) -> DataFrame:
    step = FeatureStep("size", "BINNING", ("l_quantity",), {"edges": [5.0, 15.0, 30.0, 45.0], "labels": ["small", "medium", "large"]})
    return add(table(spark, sf, "lineitem"), step).select(*KEY.split(", "), "size")


@query(
    """select event_id, cast(year(ts) as integer) as year, cast(month(ts) as integer) as month, cast(day(ts) as integer) as day, cast(isodow(ts) - 1 as integer) as dayofweek,
 cast(hour(ts) as integer) as hour, case when isodow(ts) >= 6 then 1 else 0 end as is_weekend from events"""
)
def date_parts(spark, sf) -> DataFrame:
    steps = [FeatureStep(p, "DATETIME_EXPAND", ("ts",), {"kind": p}) for p in fx.DATE_PARTS]
    return add(table(spark, sf, "events"), *steps).select("event_id", *fx.DATE_PARTS)


@query("select c_custkey, count(*) over (partition by c_mktsegment) as segment_count, count(*) over (partition by c_nationkey) as nation_count from customer")
def frequency_encoding(spark, sf) -> DataFrame:
    df = add(
        table(spark, sf, "customer"),
        FeatureStep("segment_count", "CATEGORY_ENCODE", ("c_mktsegment",), {"kind": "frequency"}),
        FeatureStep("nation_count", "CATEGORY_ENCODE", ("c_nationkey",), {"kind": "frequency"}),
    )
    return df.select("c_custkey", "segment_count", "nation_count")


@query(f"{ctes('orders_dirty')} select o_orderkey, case when priority is not null then count(*) over (partition by priority) end as priority_count from orders_dirty")
def frequency_encoding_nulls(spark, sf) -> DataFrame:
    df = add(view(spark, sf, "orders_dirty"), FeatureStep("priority_count", "CATEGORY_ENCODE", ("priority",), {"kind": "frequency"}))
    return df.select("o_orderkey", "priority_count")


@query("select c_custkey, ('0x' || substr(md5(c_name), 1, 8))::bigint % 16 as name_hash, ('0x' || substr(md5(cast(c_nationkey as varchar)), 1, 8))::bigint % 8 as nation_hash from customer")
def hash_encoding(spark, sf) -> DataFrame:
    df = add(
        table(spark, sf, "customer"),
        FeatureStep("name_hash", "CATEGORY_ENCODE", ("c_name",), {"kind": "hash", "buckets": 16}),
        FeatureStep("nation_hash", "CATEGORY_ENCODE", ("c_nationkey",), {"kind": "hash", "buckets": 8}),
    )
    return df.select("c_custkey", "name_hash", "nation_hash")


@query(
    f"""{ctes('documents_labelled')} select doc_id, cast(coalesce(quality, 0) + coalesce(toxic, 0) as double) as total, case when quality is null and toxic is null then null else (coalesce(quality, 0) + coalesce(toxic, 0))
 / cast((quality is not null)::int + (toxic is not null)::int as double) end as mean, cast((quality is not null)::int + (toxic is not null)::int as integer) as known from documents_labelled"""
)
def row_aggregates(spark, sf) -> DataFrame:
    steps = [FeatureStep(n, "AGGREGATION", ("quality", "toxic"), {"kind": k}) for n, k in (("total", "sum"), ("mean", "mean"), ("known", "count"))]
    return add(view(spark, sf, "documents_labelled"), *steps).select("doc_id", "total", "mean", "known")


@query(
    r"""select doc_id, cast(length(text) as integer) as length, cast(len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) as integer) as tokens, cast(regexp_matches(text, '[0-9]{3}') as integer) as digits from documents"""
)
def text_features(spark, sf) -> DataFrame:
    df = add(
        table(spark, sf, "documents"),
        FeatureStep("length", "TEXT_FEATURE", ("text",), {"kind": "length"}),
        FeatureStep("tokens", "TEXT_FEATURE", ("text",), {"kind": "tokens"}),
        FeatureStep("digits", "TEXT_FEATURE", ("text",), {"kind": "matches", "pattern": "[0-9]{3}"}),
    )
    return df.select("doc_id", "length", "tokens", "digits")


@query(f"select {KEY}, round(case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice * (1 - l_discount) end, 4) as net from lineitem")
def custom_feature(spark, sf) -> DataFrame:
    step = FeatureStep("net", "CUSTOM_FEATURE", ("l_returnflag", "l_extendedprice", "l_discount"), {"sql": "case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice * (1 - l_discount) end"})
    return add(table(spark, sf, "lineitem"), step).select(*KEY.split(", "), F.round("net", 4).alias("net"))


@query(f"{ctes('documents_labelled')} select p as pattern, count(*) as n from (select (quality is null)::int::varchar || (toxic is null)::int::varchar || (lang is null)::int::varchar as p from documents_labelled) group by p")
def missingness_patterns(spark, sf) -> DataFrame:
    df = view(spark, sf, "documents_labelled").select(fx.missing_pattern(["quality", "toxic", "lang"]).alias("pattern"))
    return df.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


LEAKY = [
    FeatureStep("month", "DATETIME_EXPAND", ("o_orderdate",), {"kind": "month"}),
    FeatureStep("price_log", "NUMERIC_TRANSFORM", ("o_totalprice",), {"kind": "log1p"}),
    FeatureStep("hidden", "CUSTOM_FEATURE", ("o_custkey",), {"sql": "o_custkey + o_totalprice / 2"}),
    FeatureStep("o_totalprice", "CUSTOM_FEATURE", ("o_custkey",), {"sql": "o_custkey * 2"}),
    FeatureStep("harmless", "CUSTOM_FEATURE", ("o_orderstatus",), {"sql": "concat(o_orderstatus, ' o_totalprice')"}),
]


@query("select o_orderkey, cast(month(o_orderdate) as integer) as month, o_orderstatus || ' o_totalprice' as harmless from orders")
def leakage_lint(spark, sf) -> DataFrame:
    """Steps that read or make the target go, judged by what the expression resolves to, not by its text."""
    df = table(spark, sf, "orders")
    kept = fr.leakage_lint(LEAKY, df, "o_totalprice")
    return add(df, *kept).drop("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("select problem, (select count(*) from lineitem) as rows from (values ('l_tax exists already'), ('share looks at more than its row')) t(problem)")
def additivity_lint(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem")
    steps = [FeatureStep("l_tax", "CUSTOM_FEATURE", ("l_tax",), {"sql": "l_tax * 2"}), FeatureStep("share", "CUSTOM_FEATURE", ("l_tax",), {"sql": "l_tax / sum(l_tax) over ()"})]
    problems = spark.createDataFrame([(p,) for p in fr.additivity_problems(steps, df)], "problem string")
    return problems.withColumn("rows", df.agg(F.count(F.lit(1))).scalar())


DISGUISED = [
    FeatureStep("net", "CUSTOM_FEATURE", ("l_quantity", "l_discount"), {"sql": "case when l_returnflag = 'R' then l_quantity * (1 - l_discount) end"}),
    FeatureStep("packed", "CUSTOM_FEATURE", ("l_quantity",), {"sql": "length(to_json(struct(*)))"}),
    FeatureStep("noise", "CUSTOM_FEATURE", ("l_quantity",), {"sql": "l_quantity + rand(3)"}),
    FeatureStep("share", "CUSTOM_FEATURE", ("l_tax",), {"sql": "l_tax / sum(l_tax) over (partition by l_suppkey)"}),
    FeatureStep("pieces", "CUSTOM_FEATURE", ("l_tax",), {"sql": "explode(array(l_tax, l_discount))"}),
    FeatureStep("l_tax", "CUSTOM_FEATURE", ("l_tax",), {"sql": "l_tax * 2"}),
    FeatureStep("age", "CUSTOM_FEATURE", ("l_shipdate",), {"sql": "datediff(current_date(), l_shipdate)"}),
]


@query(
    """select v.* from (select count(*) as n, count(*) filter (where l_returnflag = 'R') as r from lineitem) t,
 lateral (values (1, 'net', 'none', r), (2, 'packed', 'leak', n), (3, 'noise', 'repeatable', n), (4, 'share', 'row', null), (5, 'pieces', 'row', null), (6, 'l_tax', 'new', null), (7, 'age', 'repeatable', n)) v(position, new_column, rule, "values")"""
)
def feature_lint_steps(spark, sf) -> DataFrame:
    """What each feature step breaks, read off its resolved plan, beside the rows it would give a value."""
    found = fr.feature_lint_table(DISGUISED, table(spark, sf, "lineitem"), "l_extendedprice")
    return found.select("position", "new_column", "rule", "values")


def _rounds(df: DataFrame, number: int) -> list[FeatureStep]:
    return {
        1: [FeatureStep("month", "DATETIME_EXPAND", ("o_orderdate",), {"kind": "month"}), FeatureStep("leak", "NUMERIC_TRANSFORM", ("o_totalprice",), {"kind": "abs"})],
        2: [FeatureStep("quarter_start", "CUSTOM_FEATURE", ("month",), {"sql": "cast(month in (1, 4, 7, 10) as int)"})],
    }.get(number, [])


@query("select o_orderkey, cast(month(o_orderdate) as integer) as month, cast(month(o_orderdate) in (1, 4, 7, 10) as integer) as quarter_start from orders")
def feature_rounds(spark, sf) -> DataFrame:
    """Rounds build on each other; an empty round ends the run."""
    return fr.run_rounds(table(spark, sf, "orders"), "o_totalprice", _rounds).table.select("o_orderkey", "month", "quarter_start")


_FOLDS = f"s as ({FOLD_SQL.format(s='o_orderstatus', t='orders')}), c as (select o_orderpriority as p, count(*) as priority_count from s where fold = 'train' group by 1)"


@query(f"with {_FOLDS} select o_orderkey, fold, cast(month(o_orderdate) as integer) as month, priority_count from s left join c on p = o_orderpriority")
def features_on_folds(spark, sf) -> DataFrame:
    """Frequencies come from the training fold for every fold."""
    folds = three_way_split(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus")
    steps = [FeatureStep("month", "DATETIME_EXPAND", ("o_orderdate",), {"kind": "month"}), FeatureStep("priority_count", "CATEGORY_ENCODE", ("o_orderpriority",), {"kind": "frequency"})]
    fitted = fr.fit(steps, folds[0])
    out = None
    for name, fold in zip(("train", "val", "test"), folds):
        one = fr.replay_features(steps, fold, fitted).select("o_orderkey", F.lit(name).alias("fold"), "month", "priority_count")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """select * from (values ('o_orderdate_month', 'DATETIME_EXPAND'), ('o_orderdate_dayofweek', 'DATETIME_EXPAND'), ('o_orderdate_is_weekend', 'DATETIME_EXPAND'), ('clerk_frequency', 'CATEGORY_ENCODE'), ('squared_log1p', 'NUMERIC_TRANSFORM')) t(new_column, operation)
 where (select skewness(cast(o_custkey as double) ** 4) from orders) > 1 and (select count(distinct o_custkey) from orders) > 50"""
)
def feature_proposals(spark, sf) -> DataFrame:
    """Ideas that follow from a profile by rule."""
    df = table(spark, sf, "orders").select(
        "o_totalprice", "o_orderdate", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("clerk"), F.pow(F.col("o_custkey"), F.lit(4)).alias("squared")
    )
    ideas = fr.propose_features(pr.profile(df, pr.ProfileOptions(as_of=AS_OF)), "o_totalprice", df.columns)
    return spark.createDataFrame([(s.new_column, s.operation) for s in ideas], "new_column string, operation string")
