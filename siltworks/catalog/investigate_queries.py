"""Investigation operators (family G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.catalog.registry import Family
from siltworks.catalog.source_queries import date_sql
from siltworks.catalog.views import ctes, table, view
from siltworks.operators import investigate as iv

family = Family()
QUERIES, ORACLES = family.queries, family.oracles
query = family.query


@query(
    """select o_orderkey, o_orderstatus, o_totalprice, (select count(*) from orders where o_totalprice > 400000 and o_orderstatus = 'F') as matches
 from orders where o_totalprice > 400000 and o_orderstatus = 'F' order by o_orderkey limit 5"""
)
def inspect_rows(spark, sf) -> DataFrame:
    return iv.inspect_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_totalprice > 400000 and o_orderstatus = 'F'", "o_orderkey")


@query(
    """with g as (select a.o_orderstatus, b.o_orderpriority from (select distinct o_orderstatus from orders) a, (select distinct o_orderpriority from orders) b),
 n as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all)
 select g.o_orderstatus, g.o_orderpriority, coalesce(n, 0) as count, round(coalesce(n, 0) * 100.0::double / (select count(*) from orders), 2) as pct
 from g left join n using (o_orderstatus, o_orderpriority) order by 3 desc, 1, 2 limit 10"""
)
def cross_column_frequency(spark, sf) -> DataFrame:
    return iv.cross_column_frequency(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    """with g as (select a.l_returnflag, b.l_linestatus from (select distinct l_returnflag from lineitem) a, (select distinct l_linestatus from lineitem) b),
 n as (select l_returnflag, l_linestatus, count(*) as n from lineitem group by all)
 select g.l_returnflag, g.l_linestatus, coalesce(n, 0) as count, round(coalesce(n, 0) * 100.0::double / (select count(*) from lineitem), 2) as pct from g left join n using (l_returnflag, l_linestatus)"""
)
def cross_column_frequency_complete(spark, sf) -> DataFrame:
    """More room than pairs: the combinations that never occur are listed too."""
    return iv.cross_column_frequency(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", 50)


@query(
    f"""{ctes('orders_dirty')}, p as (select status, case when priority like ' %' then 'padded' when o_orderkey % 2 = 0 then 'even' end as kind from orders_dirty),
 g as (select a.status, b.kind from (select distinct status from p where kind is not null) a, (select distinct kind from p where kind is not null and status is not null) b),
 n as (select status, kind, count(*) as n from p where kind is not null group by all)
 select g.status, g.kind, coalesce(n, 0) as count, round(coalesce(n, 0) * 100.0::double / (select count(*) from p), 2) as pct from g left join n using (status, kind)"""
)
def cross_column_frequency_nulls(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty").selectExpr("status", "case when priority like ' %' then 'padded' when o_orderkey % 2 = 0 then 'even' end as kind")
    return iv.cross_column_frequency(df, "status", "kind", 50)


@query(
    f"""{ctes('order_lines')} select count(*) as valid_rows, count(*) filter (where o_orderdate > l_shipdate) as violations, round(count(*) filter (where o_orderdate > l_shipdate) * 100.0::double / count(*), 1) as pct from order_lines"""
)
def temporal_ordering(spark, sf) -> DataFrame:
    return iv.temporal_ordering(view(spark, sf, "order_lines"), "o_orderdate", "l_shipdate")


@query(
    f"""{ctes('orders_dirty')}, d as (select {date_sql('order_date_s')} as a, o.o_orderdate as b from orders_dirty join orders o using (o_orderkey))
 select count(a) as valid_rows, count(*) filter (where a > b) as violations, round(count(*) filter (where a > b) * 100.0::double / count(a), 1) as pct from d"""
)
def temporal_ordering_text(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty").join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return iv.temporal_ordering(df, "order_date_s", "o_orderdate")


@query(
    f"{ctes('orders_dirty')} select o.o_orderkey, d.order_date_s, strftime(o.o_orderdate, '%Y-%m-%d') as o_orderdate from orders_dirty d join orders o using (o_orderkey) where {date_sql('order_date_s')} > o.o_orderdate order by 1 limit 5"
)
def temporal_violations(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty").join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    out = iv.temporal_violations(df, "order_date_s", "o_orderdate", "o_orderkey")
    return out.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def histogram_sql(column: str, source: str, bins: int = 20) -> str:
    return f"""v as (select {column} as x from {source} where isfinite({column})), b as (select min(x) as lo, max(x) as hi, (max(x) - min(x)) / {bins} as w from v),
 n as (select cast(least(floor((x - lo) / w), {bins - 1}) as integer) as bin, count(*) as n from v, b group by 1)
 select cast(i as integer) as bin, round(lo + i * w, 4) as low, round(case when i = {bins - 1} then hi else lo + (i + 1) * w end, 4) as high, coalesce(n, 0) as count
 from range({bins}) r(i) cross join b left join n on n.bin = i"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in ("low", "high")})


@query("with " + histogram_sql("l_extendedprice", "lineitem"))
def value_histogram(spark, sf) -> DataFrame:
    return rounded(iv.value_distribution(table(spark, sf, "lineitem"), "l_extendedprice"))


@query(f"{ctes('orders_dirty')}, " + histogram_sql("amount", "orders_dirty"))
def value_histogram_dirty(spark, sf) -> DataFrame:
    return rounded(iv.value_distribution(view(spark, sf, "orders_dirty"), "amount"))


@query(
    f"""{ctes('orders_dirty')}, v as (select order_date_s as value, count(*) as n from orders_dirty group by 1), t as (select sum(n) as total, count(*) as d from v)
 select cast(rank as integer) as rank, value, n as count, round(n * 100.0::double / total, 1) as pct, d as n_distinct, greatest(d - 25, 0) as unlisted
 from (select *, row_number() over (order by n desc, value) as rank from v), t where rank <= 25"""
)
def category_distribution(spark, sf) -> DataFrame:
    return iv.value_distribution(view(spark, sf, "orders_dirty"), "order_date_s")


def overlap_sql(columns, source: str) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return (
        " union all ".join(
            f"select '{a}' as column_a, '{b}' as column_b, count(*) filter (where {a} is null and {b} is null) as both_null, count(*) filter (where {a} is null or {b} is null) as either from {source}" for a, b in pairs
        )
    )


@query(
    f"{ctes('documents_labelled')}, p as ({overlap_sql(('doc_id', 'lang', 'source', 'n_chars', 'quality', 'toxic'), 'documents_labelled')}) select column_a, column_b, both_null, round(both_null * 1.0::double / either, 3) as overlap from p where either > 0 and both_null * 1.0 / either >= 0.5"
)
def null_co_occurrence(spark, sf) -> DataFrame:
    return iv.null_co_occurrence(view(spark, sf, "documents_labelled").drop("text"))


@query(
    f"{ctes('orders_dirty')}, p as ({overlap_sql(('amount', 'amount_s', 'order_date_s', 'priority', 'status'), 'orders_dirty')}) select column_a, column_b, both_null, round(both_null * 1.0::double / either, 3) as overlap from p where either > 0 and both_null > 0"
)
def null_co_occurrence_any(spark, sf) -> DataFrame:
    return iv.null_co_occurrence(view(spark, sf, "orders_dirty"), threshold=1e-9)


_OTHERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")


@query(
    "with r as ("
    + " union all ".join(f"select '{c}' as \"column\", corr({c}, l_extendedprice) as r from lineitem" for c in _OTHERS)
    + ") select \"column\", round(r, 6) as r, case when r > 0 then '+' else '-' end as direction, round(abs(r), 6) as strength from r order by abs(r) desc, 1 limit 10"
)
def correlation_scan(spark, sf) -> DataFrame:
    out = iv.correlation_scan(table(spark, sf, "lineitem"), "l_extendedprice")
    return out.withColumns({c: F.round(c, 6) for c in ("r", "strength")})


@query(
    f"""{ctes('orders_dirty')} select 'o_custkey' as "column", round(corr(o_custkey, case when isfinite(amount) then amount end), 6) as r from orders_dirty
 union all select 'o_orderkey', round(corr(o_orderkey, case when isfinite(amount) then amount end), 6) from orders_dirty"""
)
def correlation_with_gaps(spark, sf) -> DataFrame:
    out = iv.correlation_scan(view(spark, sf, "orders_dirty"), "amount")
    return out.select("column", F.round("r", 6).alias("r"))
