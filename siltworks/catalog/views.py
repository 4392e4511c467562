"""Derived tables: the given tables with defects planted by rule. The same SQL text runs in both engines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

AS_OF = dt.date(2026, 1, 1)

ORDERS_DIRTY = """
select o_orderkey, o_custkey,
 case when o_orderkey % 20 = 0 then null when o_orderkey % 20 = 1 then cast(-1 as double)
      when o_orderkey % 20 = 2 then cast(9999 as double)
      when o_orderkey % 500 = 3 then cast('Infinity' as double) else o_totalprice end as amount,
 case when o_orderkey % 20 = 0 then null when o_orderkey % 30 = 1 then 'ten'
      when o_orderkey % 30 = 2 then concat(cast(cast(floor(o_totalprice) as bigint) as string), ' USD')
      else cast(cast(floor(o_totalprice) as bigint) as string) end as amount_s,
 case when o_orderkey % 25 = 0 then 'not_a_date' when o_orderkey % 25 = 1 then '2026-13-01'
      when o_orderkey % 25 in (2,3) then concat(substr(cast(o_orderdate as string),6,2),'/',
           substr(cast(o_orderdate as string),9,2),'/',substr(cast(o_orderdate as string),1,4))
      when o_orderkey % 997 = 4 then '2099-05-01'
      else substr(cast(o_orderdate as string),1,10) end as order_date_s,
 case when o_orderkey % 10 = 0 then concat(' ', o_orderpriority, ' ')
      when o_orderkey % 40 = 5 then null else o_orderpriority end as priority,
 case when o_orderkey % 331 = 7 then 'RARE' else o_orderstatus end as status,
 concat('user', cast(o_custkey as string), '@example.com') as email
from orders
"""

DOCUMENTS_LABELLED = "select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id)"

ORDER_LINES = """
select l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, o_orderdate, o_orderkey
from lineitem join orders on l_orderkey = o_orderkey
"""

# Events in the role of a run log: user = session, event = sequence, view starts a node, purchase ends it.
RUN_LOG = """
select user_id as session, event_id as seq, ts, event_type, value, props,
 concat('node', cast(user_id % 2 as string), cast(event_id % 3 as string)) as node,
 concat('model', cast(event_id % 4 as string)) as model
from events
"""

LOG_LINES = """
select event_id, user_id,
 case when event_type = 'click' then concat('ROUTE router', cast(event_id % 3 as string), ' → step', cast(event_id % 5 as string),
        ' (pass_count=', cast(event_id % 4 as string), ', retry=', cast(event_id % 2 as string), ', pass_count=9, loose)')
      when event_type = 'view' then concat('NODE node', cast(event_id % 3 as string), ' | started with ', event_type, ' | rows=', cast(event_id as string), ' k=v=w')
      when event_type = 'purchase' then concat('TOOL_CALL tool', cast(event_id % 6 as string), chr(10), '  params: ', props, chr(10), '  result: found ', cast(event_id as string), ' rows')
      when event_type = 'signup' then concat('PROFILE_SUMMARY rows=', cast(event_id as string))
      else concat('something failed for user ', cast(user_id as string)) end as line,
 case when event_type = 'error' then 'WARNING' else 'DEBUG' end as level
from events
"""

VIEWS = {
    "orders_dirty": ORDERS_DIRTY,
    "documents_labelled": DOCUMENTS_LABELLED,
    "order_lines": ORDER_LINES,
    "run_log": RUN_LOG,
    "log_lines": LOG_LINES,
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table as a lazy plan over the given ones."""
    text = VIEWS[name]
    frames = {n: table(spark, folder, n) for n in ("orders", "documents", "labels", "lineitem", "events") if f" {n}" in text}
    for n, frame in frames.items():
        text = text.replace(f"from {n}", f"from {{{n}}}").replace(f"join {n}", f"join {{{n}}}")
    return spark.sql(text, **frames)


def ctes(*names: str) -> str:
    """The same derived tables as common table expressions."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n].strip()})" for n in names)
