"""Anomaly summary (family F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.catalog.registry import Family
from siltworks.catalog.views import ctes, table, view
from siltworks.operators import anomaly as an

family = Family()
QUERIES, ORACLES = family.queries, family.oracles
query = family.query

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def fence_sql(columns, source: str) -> str:
    return (
        "f as (select "
        + ", ".join(
            f"avg({c}) as m_{c}, stddev_samp({c}) as s_{c}, quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.75) as q3_{c}" for c in columns
        )
        + f" from {source})"
    )


def z_sql(c: str) -> str:
    return f"(s_{c} > 0 and ({c} < m_{c} - 3 * s_{c} or {c} > m_{c} + 3 * s_{c}))"


def iqr_sql(c: str) -> str:
    return f"(q3_{c} - q1_{c} > 0 and ({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) or {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c})))"


def flag_sql(c: str) -> str:
    return f"coalesce({z_sql(c)} or {iqr_sql(c)}, false)"


FINITE = "select * replace (case when isfinite(amount) then amount end as amount) from orders_dirty"


@query(
    "with " + fence_sql(NUMBERS, "lineitem") + " " + " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {z_sql(c)}) as z_outliers, count(*) filter (where {iqr_sql(c)}) as iqr_outliers from lineitem, f" for c in NUMBERS)
)
def outliers_by_method(spark, sf) -> DataFrame:
    """z-score and IQR outliers counted apart."""
    df = table(spark, sf, "lineitem").select(*NUMBERS)
    bounds = an.fences(df)
    out = None
    for name, keep in (("z_outliers", "z"), ("iqr_outliers", "iqr")):
        cut = {c: an.Fence(b.mean, *((b.low_z, b.high_z, None, None) if keep == "z" else (None, None, b.low_iqr, b.high_iqr))) for c, b in bounds.items()}
        one = an.outlier_counts(df, cut).select("column", F.col("outlier_count").alias(name))
        out = one if out is None else out.join(one, "column")
    return out


DIRECTION = "case when h > 0 and l > 0 then 'both' when h > 0 then 'high' when l > 0 then 'low' else 'none' end"


@query(
    f"{ctes('orders_dirty')}, o as ({FINITE}), "
    + fence_sql(("amount", "o_custkey"), "o")
    + ", k as ("
    + " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {flag_sql(c)} and {c} > m_{c}) as h, count(*) filter (where {flag_sql(c)} and {c} <= m_{c}) as l from o, f" for c in ("amount", "o_custkey"))
    + f') select "column", h + l as outlier_count, {DIRECTION} as outlier_direction from k'
)
def outlier_counts(spark, sf) -> DataFrame:
    return an.outlier_counts(view(spark, sf, "orders_dirty").select("amount", "o_custkey"))


@query(
    f"""{ctes('orders_dirty')}, v as (select 'status' as "column", status as value, count(*) as n from orders_dirty group by 2 union all select 'priority', priority, count(*) from orders_dirty where priority is not null group by 2),
 t as (select *, n * 1.0::double / sum(n) over (partition by "column") as share from v),
 r as (select *, row_number() over (partition by "column" order by n desc, value) as rank from t where share < 0.01) select "column", cast(rank as integer) as rank, value, n from r where rank <= 10"""
)
def rare_categories(spark, sf) -> DataFrame:
    return an.rare_categories(view(spark, sf, "orders_dirty"), ["status", "priority"])


@query(
    """with v as (select o_custkey, count(*) as n from orders group by 1), t as (select 'c' || o_custkey as value, n, sum(n) over () as total from v),
 r as (select value, n, row_number() over (order by n desc, value) as rank from t where n < 0.01 * total) select 'customer' as "column", cast(rank as integer) as rank, value, n from r where rank <= 10"""
)
def rare_among_many(spark, sf) -> DataFrame:
    """A column in which every value is rare: only the frequent ones are ever gathered, and there are none."""
    df = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"))
    return an.rare_categories(df)


@query(
    f"{ctes('orders_dirty')}, o as ({FINITE}), "
    + fence_sql(("amount", "o_custkey"), "o")
    + f""", s as (select status, count(*) * 1.0 / sum(count(*)) over () as share from o group by 1)
 select count(*) as total_rows, count(*) filter (where {flag_sql("amount")} or {flag_sql("o_custkey")} or o.status in (select status from s where share < 0.01)) as total_anomalous_rows from o, f"""
)
def anomalous_rows(spark, sf) -> DataFrame:
    return an.anomalous_rows(view(spark, sf, "orders_dirty").select("amount", "o_custkey", "status"))


_NUM, _TXT = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUMBERS), ("l_returnflag", "l_linestatus")


@query(
    "with "
    + fence_sql(_NUM, "lineitem")
    + ", k as ("
    + " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {flag_sql(c)} and {c} > m_{c}) as h, count(*) filter (where {flag_sql(c)} and {c} <= m_{c}) as l from lineitem, f" for c in _NUM)
    + "), t as (select count(*) as total_rows, count(*) filter (where "
    + " or ".join(flag_sql(c) for c in _NUM)
    + f""") as total_anomalous_rows from lineitem, f)
 select "column", h + l as outlier_count, {DIRECTION} as outlier_direction, null::varchar as rare_categories, total_rows, total_anomalous_rows from k, t
 union all select c, 0, 'none', null, total_rows, total_anomalous_rows from t, (values ('l_returnflag'), ('l_linestatus')) v(c)"""
)
def anomaly_summary(spark, sf) -> DataFrame:
    return an.anomaly_summary(table(spark, sf, "lineitem"))
