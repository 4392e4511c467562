"""Violation detection (family H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.catalog.anomaly_queries import fence_sql, flag_sql
from siltworks.catalog.profile_queries import CLEANING, DIRTY_TYPES
from siltworks.catalog.registry import Family
from siltworks.catalog.source_queries import date_sql, number_sql
from siltworks.catalog.views import AS_OF, ctes, table, view
from siltworks.operators import anomaly as an
from siltworks.operators import profiling as pr
from siltworks.operators import near_copies as nc
from siltworks.operators import violations as vl
from siltworks.operators.inference import inferred_map
from siltworks.plans.recipe import replay


family = Family()
QUERIES, ORACLES = family.queries, family.oracles
query = family.query


def shown(violations: DataFrame) -> DataFrame:
    """The fields of a finding that are compared."""
    return violations.select("severity", "category", "subtype", F.array_join("affected_columns", ",").alias("columns"), "n_rows")


def row(category: str, severity: str, subtype: str | None, columns: str, count: str, source: str = "orders_dirty") -> str:
    kind = "null::varchar" if subtype is None else f"'{subtype}'"
    return f"select '{severity}' as severity, '{category}' as category, {kind} as subtype, '{columns}' as columns, count(*) filter (where {count}) as n_rows from {source}"


FIN = "case when isfinite(amount) then amount end"


@query(
    f"""{ctes('orders_dirty')} select 'CRITICAL' as severity, 'SENTINEL_VALUE' as category, null::varchar as subtype, 'amount' as columns, n as n_rows from
 (select count(*) filter (where isfinite(amount) and amount = s) as n, count({FIN}) as base from orders_dirty, (values (-1), (0), (999), (9999)) t(s) group by s) where n > 0 and n >= 0.05 * base
 union all {row("SENTINEL_VALUE", "CRITICAL", None, "amount", "isinf(amount)")}"""
)
def detect_sentinels(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty").select("amount", "status")
    rules = vl.Rules(target="amount")
    return shown(vl.run_checks(df, vl.sentinel_checks(df, rules, inferred_map(df))))


@query(f"{ctes('order_lines')} {row('TEMPORAL_VIOLATION', 'CRITICAL', None, 'o_orderdate,l_shipdate', 'o_orderdate > l_shipdate', 'order_lines')}")
def detect_temporal(spark, sf) -> DataFrame:
    df = view(spark, sf, "order_lines")
    return shown(vl.run_checks(df, vl.temporal_checks(df, vl.Rules(ordered_dates=[("o_orderdate", "l_shipdate")]))))


@query(
    row("CROSS_COLUMN_LOGIC", "CRITICAL", None, "l_discount,l_tax", "not (l_discount >= l_tax)", "lineitem")
    + " union all "
    + row("CROSS_COLUMN_LOGIC", "CRITICAL", None, "l_extendedprice,l_quantity", "not (l_extendedprice >= l_quantity * 100)", "lineitem")
)
def detect_cross_column(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem")
    rules = vl.Rules(row_rules={"l_discount >= l_tax": "l_discount,l_tax", "l_extendedprice >= l_quantity * 100": "l_extendedprice,l_quantity"})
    return shown(vl.run_checks(df, vl.row_rule_checks(rules)))


_UNIT = r"regexp_matches(amount_s, '^\s*([+-]?\d+(\.\d+)?)\s*[A-Za-z/]+\s*$')"


@query(
    f"{ctes('orders_dirty')} {row('TYPE_ERROR', 'CRITICAL', 'STORED_AS_TEXT', 'amount_s', 'amount_s is not null')} union all {row('TYPE_ERROR', 'CRITICAL', 'UNIT_SUFFIX', 'amount_s', _UNIT)} union all {row('TYPE_ERROR', 'CRITICAL', 'STORED_AS_TEXT', 'order_date_s', 'order_date_s is not null')}"
)
def detect_type_errors(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty")
    return shown(vl.run_checks(df, vl.type_checks(df, inferred_map(df))))


@query(f"{ctes('orders_dirty')} {row('MISSING_DATA', 'CRITICAL', None, 'amount', f'({FIN}) is null')}")
def detect_missing_target(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty")
    return shown(vl.run_checks(df, vl.missing_checks(df, vl.Rules(target="amount"))))


@query(
    f"{ctes('orders_dirty')}, o as (select * replace ({FIN} as amount) from orders_dirty), {fence_sql(('amount', 'o_custkey'), 'o')} "
    + row("OUTLIER", "CRITICAL", "IMPOSSIBLE", "amount", f"({FIN}) < 0 or ({FIN}) > 450000")
    + " union all "
    + row("OUTLIER", "CRITICAL", "TEMPORAL", "order_date_s", f"{date_sql('order_date_s')} > timestamp '{AS_OF}'")
    + f" union all select * from ({row('OUTLIER', 'INFO', 'STATISTICAL', 'amount', flag_sql('amount'), 'o, f')}) where n_rows > 0"
    + f" union all select * from ({row('OUTLIER', 'INFO', 'STATISTICAL', 'o_custkey', flag_sql('o_custkey'), 'o, f')}) where n_rows > 0"
)
def detect_outliers(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty").select("amount", "o_custkey", "order_date_s")
    rules = vl.Rules(as_of=AS_OF, ranges={"amount": (0.0, 450000.0)})
    return shown(vl.run_checks(df, vl.outlier_checks(df, rules, inferred_map(df), an.fences(df))))


@query(
    """select 'document texts' as what, count(*) as groups, cast(coalesce(sum(n), 0) as bigint) as rows, cast(coalesce(sum(n - 1), 0) as bigint) as surplus from (select count(*) as n from documents group by text having count(*) > 1)
 union all select 'line keys', count(*), cast(coalesce(sum(n), 0) as bigint), cast(coalesce(sum(n - 1), 0) as bigint) from (select count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
 union all select 'whole lines', count(*), cast(coalesce(sum(n), 0) as bigint), cast(coalesce(sum(n - 1), 0) as bigint) from (select count(*) as n from lineitem group by all having count(*) > 1)""".replace(
        "from lineitem group by all", "from (select *, 1 as one from lineitem) group by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
    )
)
def detect_duplicates(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    parts = {"document texts": vl.duplicate_summary(table(spark, sf, "documents"), ["text"]), "line keys": vl.duplicate_summary(lines, ["l_orderkey", "l_linenumber"]), "whole lines": vl.duplicate_summary(lines)}
    out = None
    for what, one in parts.items():
        one = one.select(F.lit(what).alias("what"), "groups", "rows", "surplus")
        out = one if out is None else out.unionByName(one)
    return out


_NORMAL = r"trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', ' ', 'g'))"


@query(f"select count(*) as groups, cast(coalesce(sum(n), 0) as bigint) as rows, cast(coalesce(sum(n - 1), 0) as bigint) as surplus from (select count(*) as n from (select {_NORMAL} as t from documents) group by t having count(*) > 1)")
def near_duplicates_normalised(spark, sf) -> DataFrame:
    return vl.near_duplicates_normalised(table(spark, sf, "documents"), "text")


_SHAPE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[^\p{L}\p{Nd}\s]+', '.', 'g'), '\p{Nd}+', '9', 'g'), '\p{L}+', 'A', 'g'), '\s+', '_', 'g')"


@query(
    f"{ctes('orders_dirty')}, s as ("
    + " union all ".join(f"select '{c}' as \"column\", {_SHAPE.replace('{c}', c)} as shape from orders_dirty where {c} is not null" for c in ("amount_s", "order_date_s", "priority", "status", "email"))
    + """), g as (select "column", shape, count(*) as n from s group by all), r as (select *, row_number() over (partition by "column" order by n desc, shape) as k, sum(n) over (partition by "column") as total, count(*) over (partition by "column") as shapes from g)
 select a."column", a.shape, a.n, b.shape as second_shape, b.n as second_n, a.shapes, a.total::bigint as total from r a join r b on a."column" = b."column" and a.k = 1 and b.k = 2
 where a.n >= 0.5 * a.total and a.n < 0.9 * a.total and b.n >= 0.05 * a.total"""
)
def detect_mixed_shapes(spark, sf) -> DataFrame:
    """Text columns whose values come in several shapes: the commonest two and their counts."""
    return vl.mixed_shapes(view(spark, sf, "orders_dirty"), ["amount_s", "order_date_s", "priority", "status", "email"])


# The hash functions of the sketch, written out so that the comparison does not follow the code.
_HASHES = (
    (304572262, 1938672329), (2077048831, 535143864), (319740139, 501680725), (414808610, 354535317),
    (2133449098, 2141167558), (145149928, 1913911866), (1994587971, 183052704), (493020052, 301316274),
    (692061955, 2052187672), (1903991941, 82108813), (1777399355, 975188785), (1807215801, 375712170),
)
_SKETCH = ", ".join(f"list_min(list_transform(h, lambda x: (x * {a} + {b}) % 2147483647))" for a, b in _HASHES)


@query(
    f"""with w as (select doc_id, string_split({_NORMAL}, ' ') as w from documents), s as (select doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) as s from w where len(w) >= 3),
 h as (select doc_id, list_transform(s, lambda t: ('0x' || substr(md5(t), 1, 7))::bigint) as h from s), m as (select doc_id, [{_SKETCH}] as m from h),
 b as (select doc_id, k as band, m[3 * k + 1] || '-' || m[3 * k + 2] || '-' || m[3 * k + 3] as bucket from m, range(4) r(k)),
 g as (select *, min(doc_id) over (partition by band, bucket) as anchor, count(*) over (partition by band, bucket) as n from b)
 select doc_id, min(anchor) as anchor from g where n > 1 group by doc_id"""
)
def near_duplicates(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    return vl.near_duplicates(docs, "doc_id", "text", cores if docs.rdd.getNumPartitions() < cores else None)


def _led(slots: str) -> str:
    """Each member beside its slot's leader, and whether it is similar to it."""
    return f"""select slot, doc_id, anchor, (doc_id, anchor) in (select (doc_id, anchor) from f) as near
 from (select slot, doc_id, min(doc_id) over (partition by slot) as anchor from {slots}) where doc_id <> anchor"""


@query(
    f"""with recursive w as (select doc_id, string_split({_NORMAL}, ' ') as w from documents), s as (select doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) as s from w where len(w) >= 3),
 h as (select doc_id, list_transform(s, lambda t: ('0x' || substr(md5(t), 1, 7))::bigint) as h from s), m as (select doc_id, [{_SKETCH}] as m from h),
 b as (select doc_id, k || ':' || m[3 * k + 1] || '-' || m[3 * k + 2] || '-' || m[3 * k + 3] as slot from m, range(4) r(k))"""
    + f""", c as (select distinct x.doc_id, y.doc_id as anchor from b x join b y on x.slot = y.slot and x.doc_id > y.doc_id),
 p as (select c.doc_id, c.anchor, len(list_intersect(x.s, y.s)) as shared, len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)) as united from c join s x on x.doc_id = c.doc_id join s y on y.doc_id = c.anchor),
 f as (select * from p where shared >= 0.8 * united),
 a as ({_led("b")} union all {_led("(select * from a where not near)")}),
 r as (select *, row_number() over (partition by doc_id order by anchor) as rn from f where (doc_id, anchor) in (select (doc_id, anchor) from a where near))
 select doc_id, anchor, shared::int as shared, united::int as united, round(shared * 1.0::double / united, 9) as similarity from r where rn = 1"""
)
def near_copies_verified(spark, sf) -> DataFrame:
    """Near copies beside a leader they were compared with, and their similarity; none below 0.8."""
    docs = table(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    found = nc.verified_near_copies(docs, "doc_id", "text", partitions=cores if docs.rdd.getNumPartitions() < cores else None)
    return found.withColumn("similarity", F.round("similarity", 9))


def _pii_rows(column: str, source: str) -> str:
    return " union all ".join(
        f"select * from (select 'INFO' as severity, 'PII_DETECTED' as category, '{k}' as subtype, '{column}' as columns, count(*) filter (where regexp_matches({column}, '{p}')) as n_rows, count({column}) as base from {source}) where n_rows > 0 and n_rows >= 0.5 * base"
        for k, p in vl.PII_PATTERNS.items()
    )


@query(
    f"{ctes('orders_dirty')} select severity, category, subtype, columns, n_rows from ({_pii_rows('email', 'orders_dirty')} union all {_pii_rows('amount_s', 'orders_dirty')} union all select 'INFO', 'PII_DETECTED', 'name', 'email', count(email), 0 from orders_dirty)"
)
def detect_personal_data(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty")
    return shown(vl.run_checks(df, vl.pii_checks(df)))


@query(f"select lang, {', '.join(f'''count(*) filter (where regexp_matches(text, '{p}')) as {k}''' for k, p in vl.PII_PATTERNS.items())} from documents group by lang")
def personal_data_in_texts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(*[F.count_if(F.col("text").rlike(p)).alias(k) for k, p in vl.PII_PATTERNS.items()])


@query(
    f"{ctes('orders_dirty')} "
    + row("FORMAT_INCONSISTENCY", "INFO", None, "order_date_s", f"{date_sql('order_date_s')} is not null and try_strptime(order_date_s, '%Y-%m-%d') is null")
)
def detect_mixed_formats(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty")
    return shown(vl.run_checks(df, vl.format_checks(df, DIRTY_TYPES)))


@query(
    f"""{ctes('orders_dirty')} select case when try_strptime(order_date_s, '%Y-%m-%d') is not null then 'yyyy-M-d' when try_strptime(order_date_s, '%m/%d/%Y') is not null then 'M/d/yyyy'
 when try_strptime(order_date_s, '%d/%m/%Y') is not null then 'd/M/yyyy' end as format, count(*) as n from orders_dirty where order_date_s is not null group by 1"""
)
def date_formats(spark, sf) -> DataFrame:
    return vl.date_formats(view(spark, sf, "orders_dirty"), "order_date_s")


@query(
    f"""{ctes('orders_dirty')} select 'o_orderkey' as "column", 'identifier' as reason union all select 'status_copy', 'constant' union all select 'email', 'personal data' union all select 'priority', 'leaks the outcome'"""
)
def drop_candidates(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty").select("o_orderkey", "amount", "priority", "status", "email", F.lit("x").alias("status_copy"))
    profile = pr.profile(df, pr.ProfileOptions(as_of=AS_OF))
    return vl.drop_candidates(profile, vl.run_checks(df, vl.pii_checks(df)), "amount", ["priority"])


@query(
    """select 'toxic' as target, count(distinct toxic) as n_classes, 'binary_classification' as task_type from labels
 union all select 'o_orderpriority', count(distinct o_orderpriority), 'multiclass_classification' from orders
 union all select 'o_totalprice', count(distinct o_totalprice), 'regression' from orders"""
)
def task_types(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders")
    out = vl.task_type(table(spark, sf, "labels"), "toxic")
    return out.unionByName(vl.task_type(orders, "o_orderpriority")).unionByName(vl.task_type(orders, "o_totalprice"))


@query(
    """with c as (select 'o_custkey' as "column", count(distinct o_custkey) as unique_count, 'Numeric' as kind, false as named from orders union all select 'o_orderstatus', count(distinct o_orderstatus), 'Categorical', true from orders
 union all select 'o_orderpriority', count(distinct o_orderpriority), 'Categorical', false from orders) select "column", named, 1.0::double as completeness, unique_count,
 case when named then 'named in the question; ' else '' end || kind || ', ' || unique_count || ' distinct values' as rationale from c"""
)
def target_candidates(spark, sf) -> DataFrame:
    """Identifiers and dates are never proposed; what the question names comes first."""
    profile = pr.profile(table(spark, sf, "orders").drop("o_totalprice"), pr.ProfileOptions(as_of=AS_OF))
    return vl.target_candidates(profile, "Which orders have status F?")


@query(
    f"""{ctes('orders_dirty')} select 'amount: missing_data in ' || printf('%.1f', count(*) filter (where ({FIN}) is null) * 100.0 / count(*)) || '% of rows' as caveat from orders_dirty
 union all select 'amount: sentinel_value in ' || printf('%.1f', count(*) filter (where isinf(amount)) * 100.0 / count(*)) || '% of rows' from orders_dirty"""
)
def caveats(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty").select("amount")
    rules = vl.Rules(target="amount", sentinels={"amount": []})
    found = vl.run_checks(df, [*vl.missing_checks(df, rules), *vl.sentinel_checks(df, rules, {"amount": "Numeric"})])
    return vl.caveats(df, found)


_AMOUNT_S = number_sql("amount_s")


@query(
    f"""{ctes('orders_dirty')} select 'CRITICAL' as severity, 'MISSING_DATA' as category, cast(1 as bigint) as findings, count(*) filter (where ({FIN}) is null) as n_rows from orders_dirty
 union all select 'CRITICAL', 'TYPE_ERROR', 3, count(amount_s) + count(order_date_s) + count(*) filter (where {_UNIT}) from orders_dirty
 union all select 'CRITICAL', 'OUTLIER', 1, count(*) filter (where {date_sql('order_date_s')} > timestamp '{AS_OF}') from orders_dirty"""
)
def findings_summary(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty")
    rules = vl.Rules(target="amount", as_of=AS_OF)
    types = inferred_map(df)
    found = vl.run_checks(df, [*vl.missing_checks(df, rules), *vl.type_checks(df, types), *vl.outlier_checks(df, rules, types)])
    return vl.findings_summary(found)


@query(f"{ctes('orders_dirty')} {row('PII_DETECTED', 'INFO', 'name', 'email', 'email is not null')} union all {row('PII_DETECTED', 'INFO', 'email', 'email', 'email is not null')}")
def findings_after_cleaning(spark, sf) -> DataFrame:
    """What a second pass reports: findings whose evidence is gone are not repeated, those that persist are."""
    before = view(spark, sf, "orders_dirty")
    rules = vl.Rules(target="amount")
    previous = vl.run_checks(before, [*vl.missing_checks(before, rules), *vl.pii_checks(before)])
    steps = [s for s in CLEANING if s.action != "drop_columns"]
    after = replay(steps, before, "amount").join(before.select("o_orderkey"), "o_orderkey", "right")
    kept = after.withColumn("email", F.coalesce("email", F.lit("lost@example.com")))
    current = vl.run_checks(kept.where("amount is not null or true").withColumn("amount", F.coalesce("amount", F.lit(1.0))), [*vl.missing_checks(before, rules), *vl.pii_checks(before)])
    return shown(vl.suppress_fixed(current, previous))


@query(row("OTHER", "INFO", None, "", "l_quantity > 45 and l_discount > 0.08", "lineitem") + " union all " + row("OTHER", "CRITICAL", None, "", "l_tax > 0.07", "lineitem"))
def detect_custom_rules(spark, sf) -> DataFrame:
    rules = vl.Rules(custom={"large and discounted": ("l_quantity > 45 and l_discount > 0.08", "INFO"), "heavily taxed": ("l_tax > 0.07", "CRITICAL")})
    return shown(vl.run_checks(table(spark, sf, "lineitem"), vl.custom_checks(rules)))


@query(
    f"""{ctes('orders_dirty')}, n as (select *, {_AMOUNT_S} as x, {date_sql('order_date_s')} as d from orders_dirty), r as (
 {row("MISSING_DATA", "CRITICAL", None, "amount", f"({FIN}) is null")} union all {row("SENTINEL_VALUE", "CRITICAL", None, "amount", "amount = -1")} union all {row("SENTINEL_VALUE", "CRITICAL", None, "amount", "isinf(amount)")}
 union all {row("TYPE_ERROR", "CRITICAL", "STORED_AS_TEXT", "amount_s", "amount_s is not null")} union all {row("TYPE_ERROR", "CRITICAL", "UNIT_SUFFIX", "amount_s", _UNIT)} union all {row("TYPE_ERROR", "CRITICAL", "STORED_AS_TEXT", "order_date_s", "order_date_s is not null")}
 union all {row("OUTLIER", "CRITICAL", "TEMPORAL", "order_date_s", f"{date_sql('order_date_s')} > timestamp '{AS_OF}'")} union all {row("PII_DETECTED", "INFO", "email", "email", "email is not null")} union all {row("PII_DETECTED", "INFO", "name", "email", "email is not null")}
 union all {row("FORMAT_INCONSISTENCY", "INFO", None, "order_date_s", f"{date_sql('order_date_s')} is not null and try_strptime(order_date_s, '%Y-%m-%d') is null")})
 select category, severity, cast(count(*) as bigint) as findings, cast(sum(n_rows) as bigint) as n_rows from r where n_rows > 0 and not (category = 'SENTINEL_VALUE' and n_rows < 0.05 * (select count(*) from orders) and n_rows <> (select count(*) filter (where isinf(amount)) from orders_dirty)) group by all"""
)
def detect_all(spark, sf) -> DataFrame:
    """Every row-wise check and the duplicates, in one numbered table."""
    df = view(spark, sf, "orders_dirty")
    found = vl.detect(df, vl.Rules(target="amount", as_of=AS_OF, sentinels={"amount": [-1.0]}), DIRTY_TYPES)
    # Integer columns get no declared sentinels here and hold none of the default ones often enough.
    return vl.findings_summary(found)
