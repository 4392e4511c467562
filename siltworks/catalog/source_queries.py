"""Sources, sinks and coercion (families A and B)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.catalog.registry import Family
from siltworks.catalog.views import ctes, table, view
from siltworks.functions.dates import iso
from siltworks.functions.strings import canonical_text, null_tokens_to_null
from siltworks.operators import inference as inf
from siltworks.session import scratch_path
from siltworks.sources import readers, writers

family = Family()
QUERIES, ORACLES = family.queries, family.oracles
query = family.query

# Pieces of SQL shared by the statements of several families.
SQL_NUMBER = r"""case when regexp_matches({c}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') and abs(try_cast(trim({c}) as double)) < 'infinity'::double
 then try_cast(trim({c}) as double) end"""
SQL_DATE = "coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%m/%d/%Y'), try_strptime({c}, '%d/%m/%Y'))"


def number_sql(c: str) -> str:
    return SQL_NUMBER.replace("{c}", c)


def date_sql(c: str) -> str:
    return SQL_DATE.replace("{c}", c)


@query("select count(*) as rows, count(distinct l_orderkey) as orders, cast(sum(l_linenumber) as bigint) as lines from lineitem where l_shipdate >= timestamp '1998-01-01'")
def scan_parquet(spark, sf) -> DataFrame:
    df = readers.read_parquet(spark, f"{sf}/lineitem.parquet")
    recent = df.where("l_shipdate >= timestamp_ntz '1998-01-01'")
    return recent.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("l_orderkey").alias("orders"), F.sum("l_linenumber").alias("lines"))


@query("select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, o_orderpriority from orders")
def csv_round_trip(spark, sf) -> DataFrame:
    path = scratch_path(spark, "orders-csv")
    writers.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    return readers.read_csv(spark, path, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders")
def csv_whole_table(spark, sf) -> DataFrame:
    """Every column of a table out to delimited text, back as text, and to its type again."""
    path = scratch_path(spark, "orders-whole-csv")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    writers.write_csv(orders, path)
    back = readers.read_csv(spark, path, orders.columns)
    return back.select(
        *[F.col(c).cast(orders.schema[c].dataType).alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus")],
        F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"), F.substring("o_orderdate", 1, 10).alias("o_orderdate"), "o_orderpriority",
    )


@query("select cast(doc_id as varchar) as doc_id, case when text not in ('', 'NA', 'N/A', 'NaN', 'nan', 'null', 'NULL', 'None', 'n/a', '#N/A', '<NA>') then text end as text from documents")
def csv_line_breaks(spark, sf) -> DataFrame:
    """Whole texts, line breaks, quotes and all, out to delimited text and back."""
    path = scratch_path(spark, "documents-csv")
    writers.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    return readers.read_csv(spark, path, ["doc_id", "text"])


@query("select o_orderstatus, o_orderkey, round(o_totalprice, 2) as o_totalprice from orders")
def parquet_round_trip(spark, sf) -> DataFrame:
    path = scratch_path(spark, "orders-parquet")
    writers.write_parquet(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    back = readers.read_parquet(spark, path)
    return back.select("o_orderstatus", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(f"{ctes('orders_dirty')} select o_orderkey, amount_s, priority from orders_dirty")
def json_round_trip(spark, sf) -> DataFrame:
    path = scratch_path(spark, "orders-json")
    writers.write_json(view(spark, sf, "orders_dirty").select("o_orderkey", "amount_s", "priority"), path)
    return spark.read.schema("o_orderkey long, amount_s string, priority string").json(path)


@query("""select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as json from nation""")
def json_lines(spark, sf) -> DataFrame:
    return writers.json_lines(table(spark, sf, "nation"))


@query("select d.doc_id, d.lang, d.n_chars, l.quality, l.toxic from documents d join labels l using (doc_id)")
def concat_columns(spark, sf) -> DataFrame:
    return readers.concat_columns(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf, "labels"), "doc_id")


@query(" union all ".join(f"select '{t}' as name, count(*) as rows, cast({n} as bigint) as columns from {t}" for t, n in (("orders", 6), ("lineitem", 11), ("customer", 5), ("documents", 5))))
def shape_summary(spark, sf) -> DataFrame:
    out = None
    for name in ("orders", "lineitem", "customer", "documents"):
        one = readers.shape_summary(table(spark, sf, name), name)
        out = one if out is None else out.unionByName(one)
    return out


@query("select p.page_id, p.url, d.lang as note from pages p left join documents d on d.doc_id = p.page_id")
def attach_notes(spark, sf) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url").withColumnRenamed("page_id", "row_number")
    notes = table(spark, sf, "documents").select(F.col("doc_id").alias("row_number"), F.col("lang").alias("note"))
    return readers.attach_notes(pages, notes).withColumnRenamed("row_number", "page_id")


@query(
    f"""{ctes('orders_dirty')}, r as (select {", ".join(f"avg(case when {date_sql(c)} is not null then 1.0 else 0 end) filter (where {c} is not null) as d_{c}, avg(case when {number_sql(c)} is not null then 1.0 else 0 end) filter (where {c} is not null) as n_{c}" for c in ("amount_s", "order_date_s", "priority", "status", "email"))} from orders_dirty)
 {" union all ".join(f"select '{c}' as \"column\", case when d_{c} >= 0.6 then 'Datetime' when n_{c} >= 0.6 then 'Numeric' else 'Categorical' end as inferred_type, greatest(d_{c}, n_{c}) >= 0.6 as type_mismatch from r" for c in ("amount_s", "order_date_s", "priority", "status", "email"))}
 union all select * from (values ('o_orderkey', 'Numeric', false), ('o_custkey', 'Numeric', false), ('amount', 'Numeric', false))"""
)
def infer_types(spark, sf) -> DataFrame:
    return inf.infer_types(view(spark, sf, "orders_dirty")).select("column", "inferred_type", "type_mismatch")


@query(f"{ctes('orders_dirty')} select o_orderkey, {number_sql('amount_s')} as amount from orders_dirty")
def coerce_numeric(spark, sf) -> DataFrame:
    return inf.coerce_numeric(view(spark, sf, "orders_dirty"), "amount_s", "x").select("o_orderkey", F.col("x").alias("amount"))


@query(f"{ctes('orders_dirty')} select o_orderkey, strftime({date_sql('order_date_s')}, '%Y-%m-%dT%H:%M:%S') as order_date from orders_dirty")
def coerce_datetime(spark, sf) -> DataFrame:
    return inf.coerce_datetime(view(spark, sf, "orders_dirty"), "order_date_s", "d").select("o_orderkey", iso(F.col("d")).alias("order_date"))


def _failure_sql(c: str, parsed: str) -> str:
    return f"""select '{c}' as "column", count(*) filter (where {c} is not null and {parsed} is null) as failures,
 (select coalesce(string_agg(v, '|' order by v), '') from (select distinct {c} as v from orders_dirty where {c} is not null and {parsed} is null order by 1 limit 5)) as samples from orders_dirty"""


@query(f"{ctes('orders_dirty')} {_failure_sql('amount_s', number_sql('amount_s'))} union all {_failure_sql('order_date_s', date_sql('order_date_s'))}")
def coercion_failures(spark, sf) -> DataFrame:
    return inf.coercion_failures(view(spark, sf, "orders_dirty"), {"amount_s": "Numeric", "order_date_s": "Datetime"})


@query(f"{ctes('orders_dirty')} select count(*) filter (where isinf(amount)) as infinite, count(*) filter (where amount is null) as missing from orders_dirty")
def infinities(spark, sf) -> DataFrame:
    from siltworks.functions.numbers import infinity_flag, present

    df = view(spark, sf, "orders_dirty")
    dtype = df.schema["amount"].dataType
    return df.agg(F.count_if(infinity_flag("amount", dtype)).alias("infinite"), F.count_if(~present("amount", dtype)).alias("missing"))


@query("""select cast(event_id as varchar) as event_id, replace(cast(ts as varchar), ' ', 'T') as ts, event_type, props from events""")
def json_safe_rows(spark, sf) -> DataFrame:
    return inf.json_safe(table(spark, sf, "events").select("event_id", "ts", "event_type", "props"))


@query("select vec_id, cast(len(embedding) as bigint) as dims from embeddings")
def json_safe_nested(spark, sf) -> DataFrame:
    """Arrays become JSON text that reads back to the same length."""
    df = table(spark, sf, "embeddings")
    text = canonical_text("embedding", df.schema["embedding"].dataType)
    return df.select("vec_id", F.json_array_length(text).cast("long").alias("dims"))


@query(f"{ctes('orders_dirty')} select o_orderkey, case when isfinite(amount) then amount end as amount from orders_dirty")
def non_finite_to_null(spark, sf) -> DataFrame:
    return inf.non_finite_to_null(view(spark, sf, "orders_dirty")).select("o_orderkey", "amount")


@query("select cast(l_orderkey as double) as l_orderkey, cast(l_linenumber as double) as l_linenumber, l_quantity, l_returnflag, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') as l_shipdate from lineitem")
def model_input_types(spark, sf) -> DataFrame:
    return inf.model_input(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")


@query(
    f"{ctes('orders_dirty')} select count(amount_s) as amount_s, count(*) filter (where upper(trim(priority)) not in ('', 'UNKNOWN')) as priority, count(case when status <> 'RARE' then 1 end) as status from orders_dirty"
)
def null_tokens(spark, sf) -> DataFrame:
    """Blank and null-like texts read as missing; a caller may add tokens of its own."""
    df = readers.nullify_tokens(view(spark, sf, "orders_dirty"), ["amount_s", "priority"])
    own = null_tokens_to_null(F.col("status"), ("RARE",))
    return df.agg(F.count("amount_s").alias("amount_s"), F.count("priority").alias("priority"), F.count(own).alias("status"))
