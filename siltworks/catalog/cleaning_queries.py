"""Cleaning actions, recipes and passes (family I)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.catalog.profile_queries import CLEANING
from siltworks.catalog.registry import Family
from siltworks.catalog.source_queries import date_sql, number_sql
from siltworks.catalog.views import AS_OF, ctes, table, view
from siltworks.functions.dates import iso
from siltworks.operators import cleaning as cl
from siltworks.operators.splitting import three_way_split
from siltworks.operators.violations import Rules
from siltworks.plans import recipe as rc
from siltworks.plans.passes import clean_in_passes
from siltworks.plans.recipe import Step
from siltworks.session import cut_lineage

family = Family()
QUERIES, ORACLES = family.queries, family.oracles
query = family.query

DIRTY = ctes("orders_dirty")


def run(df: DataFrame, *steps: Step) -> DataFrame:
    return rc.replay(list(steps), df)


def step(operation: str, action: str, column: str | None = None, **params) -> Step:
    return Step(1, operation, action, column, params)


@query(f"{DIRTY} select * exclude (email, o_custkey) from orders_dirty")
def drop_columns(spark, sf) -> DataFrame:
    return run(view(spark, sf, "orders_dirty"), step("drop_columns", "drop_columns", columns=["email", "o_custkey", "never_there"]))


@query(f"{DIRTY} select o_orderkey, amount from orders_dirty where not coalesce(amount < 100000, false)")
def drop_rows(spark, sf) -> DataFrame:
    """Rows for which the condition is unknown stay."""
    return run(view(spark, sf, "orders_dirty"), step("DROP_ROW", "drop_rows", condition="amount < 100000")).select("o_orderkey", "amount")


@query("select o_orderkey as order_id, o_orderstatus from orders")
def rename_column(spark, sf) -> DataFrame:
    return run(table(spark, sf, "orders"), step("RENAME_COLUMN", "rename", "o_orderkey", to="order_id")).select("order_id", "o_orderstatus")


@query(f"{DIRTY} select o_orderkey, cast({number_sql('amount_s')} as bigint) as amount_s, strftime({date_sql('order_date_s')}, '%Y-%m-%d') as order_date_s from orders_dirty")
def cast_columns(spark, sf) -> DataFrame:
    df = run(view(spark, sf, "orders_dirty"), step("CAST_TYPES", "cast", "amount_s", to="bigint"), step("CAST_TYPE", "cast", "order_date_s", to="date"))
    return df.select("o_orderkey", "amount_s", F.date_format("order_date_s", "yyyy-MM-dd").alias("order_date_s"))


@query(f"{DIRTY} select o_orderkey, upper(substr(status, 1, 1)) as status from orders_dirty")
def custom_expression(spark, sf) -> DataFrame:
    return run(view(spark, sf, "orders_dirty"), step("CUSTOM", "expression", "status", sql="upper(substr(status, 1, 1))")).select("o_orderkey", "status")


@query(f"{DIRTY} select o_orderkey, case when amount not in (-1, 9999) then amount end as amount, case when status <> 'RARE' then status end as status from orders_dirty")
def sentinels_to_null(spark, sf) -> DataFrame:
    df = run(view(spark, sf, "orders_dirty"), step("CUSTOM_CODE", "null_sentinels", "amount", values=[-1.0, 9999.0]), step("CUSTOM_CODE", "null_sentinels", "status", values=["RARE"]))
    return df.select("o_orderkey", "amount", "status")


@query(f"{DIRTY} select o_orderkey, case when isfinite(amount) and amount between 1000 and 400000 then amount end as amount, case when {number_sql('amount_s')} <= 300000 then {number_sql('amount_s')} end as amount_s from orders_dirty")
def range_to_null(spark, sf) -> DataFrame:
    df = run(view(spark, sf, "orders_dirty"), step("CUSTOM_CODE", "null_outside", "amount", low=1000.0, high=400000.0), step("CUSTOM_CODE", "null_outside", "amount_s", high=300000.0))
    return df.select("o_orderkey", "amount", "amount_s")


@query(
    rf"{DIRTY} select o_orderkey, coalesce({number_sql('amount_s')}, try_cast(nullif(regexp_extract(amount_s, '^\s*([+-]?\d+(\.\d+)?)\s*[A-Za-z/]+\s*$', 1), '') as double)) as amount_s from orders_dirty"
)
def unit_numbers(spark, sf) -> DataFrame:
    return run(view(spark, sf, "orders_dirty"), step("CUSTOM_CODE", "extract_units", "amount_s")).select("o_orderkey", "amount_s")


@query(f"{DIRTY} select o_orderkey, case when {date_sql('order_date_s')} <= timestamp '{AS_OF}' then order_date_s end as order_date_s from orders_dirty")
def future_dates_to_null(spark, sf) -> DataFrame:
    return run(view(spark, sf, "orders_dirty"), step("CUSTOM_CODE", "null_future_dates", "order_date_s", as_of=str(AS_OF))).select("o_orderkey", "order_date_s")


@query(f"{DIRTY} select o_orderkey, case when isfinite(amount) then amount end as amount from orders_dirty")
def infinite_to_null(spark, sf) -> DataFrame:
    return run(view(spark, sf, "orders_dirty"), step("CUSTOM_CODE", "null_non_finite", "amount")).select("o_orderkey", "amount")


@query(f"{DIRTY} select o_orderkey, nullif(trim(priority), '') as priority from orders_dirty")
def trim_to_null(spark, sf) -> DataFrame:
    return run(view(spark, sf, "orders_dirty"), step("CUSTOM_CODE", "trim", "priority")).select("o_orderkey", "priority")


@query(f"{DIRTY} select o_orderkey, amount from orders_dirty where amount is not null")
def drop_missing_target(spark, sf) -> DataFrame:
    return run(view(spark, sf, "orders_dirty"), step("DROP_ROWS", "drop_missing_target", "amount")).select("o_orderkey", "amount")


@query("select doc_id, lang, source, n_chars from (select *, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1")
def drop_duplicate_rows(spark, sf) -> DataFrame:
    df = run(table(spark, sf, "documents"), step("DROP_ROWS", "drop_duplicates", keys=["text"], order=["doc_id"]))
    return df.select("doc_id", "lang", "source", "n_chars")


@query("select l_returnflag, l_linestatus, l_quantity from lineitem group by all")
def drop_equal_rows(spark, sf) -> DataFrame:
    """A few hundred groups hold all rows: copies fold in the tasks before anything is shuffled."""
    return cl.drop_duplicate_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


_UNIT = rf"coalesce({number_sql('amount_s')}, try_cast(nullif(regexp_extract(amount_s, '^\s*([+-]?\d+(\.\d+)?)\s*[A-Za-z/]+\s*$', 1), '') as double))"
_AMOUNT = "case when amount not in (-1, 9999) and isfinite(amount) then amount end"
CLEANED = f"select o_orderkey, o_custkey, {_AMOUNT} as amount, {_UNIT} as amount_s, strftime({date_sql('order_date_s')}, '%Y-%m-%dT%H:%M:%S') as order_date_s, priority, status from {{source}} where ({_AMOUNT}) is not null"


def readable(df: DataFrame) -> DataFrame:
    return df.withColumn("order_date_s", iso(F.col("order_date_s")))


@query(f"{DIRTY} {CLEANED.format(source='orders_dirty')}")
def recipe_replay(spark, sf) -> DataFrame:
    """A whole recipe, in order, as one narrow stage."""
    return readable(rc.replay(CLEANING, view(spark, sf, "orders_dirty"), "amount"))


@query(
    f"""{DIRTY} select cast(row_number() over () as integer) as step_id, operation, 'SUCCESS' as status, n as rows_after from (select count(*) as all_rows, count({_AMOUNT}) as kept from orders_dirty) t,
 lateral (values ('DROP_COLUMN', all_rows), ('CUSTOM_CODE', all_rows), ('CAST_TYPE', all_rows), ('CUSTOM_CODE', all_rows), ('CUSTOM_CODE', all_rows), ('DROP_ROWS', kept)) v(operation, n)"""
)
def recipe_audit(spark, sf) -> DataFrame:
    """The audit log of a recipe that was applied as a whole, with the rows each step left."""
    outcome = rc.apply(CLEANING, view(spark, sf, "orders_dirty"), cut_lineage)
    return outcome.audit().select("step_id", "operation", "status", "rows_after")


@query("select 'SUCCESS' as status, cast(1 as bigint) as steps, (select count(*) from orders) as rows union all select 'FAILED', 1, (select count(*) from orders)")
def recipe_failure(spark, sf) -> DataFrame:
    """A step that does not resolve ends the recipe: the table comes back untouched beside the partial log."""
    df = view(spark, sf, "orders_dirty")
    broken = [CLEANING[0], Step(2, "CUSTOM_CODE", "expression", "amount", {"sql": "amount + no_such_column"}), CLEANING[5]]
    outcome = rc.apply(broken, df)
    return outcome.rollup().withColumn("rows", outcome.table.agg(F.count("email")).scalar())


BAD_RECIPE = [
    Step(1, "DROP_ROWS", "drop_missing_target", "priority"),
    Step(2, "DROP_COLUMN", "drop_columns", "amount"),
    Step(3, "CUSTOM_CODE", "expression", "status", {"sql": "coalesce(status, 'F')"}),
    Step(4, "CUSTOM_CODE", "expression", "amount_s", {"sql": "avg(o_custkey) over ()"}),
    Step(5, "DROP_ROWS", "drop_rows", None, {"condition": "priority is null"}),
]


@query(
    f"""select problem, (select count(*) from orders) as rows from (values ('drops or renames the target amount'), ('drops rows on missing priority'), ('drops rows on missing priority, which is not the target'),
 ('fills missing values'), ('steps are not in order'), ('target amount does not survive'), ('uses statistics of the whole table')) t(problem)"""
)
def recipe_lint(spark, sf) -> DataFrame:
    """What the lint finds in a recipe that breaks every rule, beside the rows it would have touched."""
    df = view(spark, sf, "orders_dirty")
    found = [re.sub(r"^step \d+ |:.*", "", p) for p in rc.lint(BAD_RECIPE, df, "amount")]
    problems = spark.createDataFrame([(p,) for p in found], "problem string")
    return problems.withColumn("rows", df.agg(F.count(F.lit(1))).scalar())


DISGUISED = [
    Step(1, "CUSTOM_CODE", "expression", "priority", {"sql": "case when priority is null then 'F' else priority end"}),
    Step(2, "CUSTOM_CODE", "expression", "amount_s", {"sql": "case when rand(7) < 2 then amount_s end"}),
    Step(3, "CUSTOM_CODE", "expression", "amount", {"sql": "concat('n', cast(amount as string))"}),
    Step(4, "DROP_ROWS", "drop_rows", None, {"condition": "isnull(amount_s)"}),
    Step(5, "CUSTOM_CODE", "trim", "priority"),
    Step(6, "CUSTOM_CODE", "expression", "order_date_s", {"sql": "if(order_date_s <=> null, cast(current_date() as string), order_date_s)"}),
]


@query(
    f"""{DIRTY} select v.step_id, v.rule, v.columns, v.rows_touched from (select count(*) filter (where priority is null) as gaps, count(amount) as priced, count(*) filter (where amount_s is null) as unpriced,
 count(*) filter (where amount_s is not null and trim(priority) <> priority) as padded from orders_dirty) t,
 lateral (values (1, 'fill', 'priority', gaps), (2, 'repeatable', '', 0), (3, 'target', 'amount', priced), (4, 'row drop', 'amount_s', unpriced), (5, 'none', '', padded),
 (6, 'fill', 'order_date_s', 0), (6, 'repeatable', '', 0)) v(step_id, rule, columns, rows_touched)"""
)
def recipe_lint_steps(spark, sf) -> DataFrame:
    """What each step of a recipe breaks, in spellings that a look at its text would miss, and how many rows it would touch."""
    found = rc.lint_table(DISGUISED, view(spark, sf, "orders_dirty"), "amount")
    return found.select("step_id", "rule", F.array_join("columns", ",").alias("columns"), "rows_touched")


PAIRED = [Step(1, "CUSTOM_CODE", "null_outside", "l_quantity", {"high": 45.0}), Step(2, "CUSTOM_CODE", "null_outside", "l_tax", {"high": 0.07})]


@query(
    """select v.step_id, v.rule, v.columns, v.rows_touched from (select count(*) filter (where l_quantity > 45) as q, count(*) filter (where l_tax > 0.07::double) as t from lineitem) c,
 lateral (values (0, 'pair', 'l_quantity,l_tax', null), (1, 'none', '', q), (2, 'none', '', t)) v(step_id, rule, columns, rows_touched)"""
)
def paired_measurements(spark, sf) -> DataFrame:
    """Two columns of one measurement are nulled although only the first was flagged: reported beside what each step would null."""
    found = rc.lint_table(PAIRED, table(spark, sf, "lineitem"), pairs=[("l_quantity", "l_tax")], flagged={"l_quantity"})
    return found.select("step_id", "rule", F.array_join("columns", ",").alias("columns"), "rows_touched")


RULES = Rules(target="amount", as_of=AS_OF, sentinels={"amount": [-1.0, 9999.0]})


def _passes(spark, sf):
    df = view(spark, sf, "orders_dirty").select("o_orderkey", "amount", "amount_s", "order_date_s", "email")
    return clean_in_passes(df, RULES)


@query(
    f"""{DIRTY}, c as (select o_orderkey, {_AMOUNT} as amount, {_UNIT} as amount_s, case when {date_sql('order_date_s')} <= timestamp '{AS_OF}' then {date_sql('order_date_s')} end as d from orders_dirty)
 select o_orderkey, amount, amount_s, strftime(d, '%Y-%m-%dT%H:%M:%S') as order_date_s from c where amount is not null"""
)
def cleaning_passes(spark, sf) -> DataFrame:
    """Detect, repair and look again until nothing critical is left."""
    return readable(_passes(spark, sf).table).select("o_orderkey", "amount", "amount_s", "order_date_s")


@query(
    f"{DIRTY}, k as (select count({_AMOUNT}) as kept from orders_dirty) select * from (values (0, true), (1, false)) t(pass_number, critical), (select kept as rows_after from k)".replace(
        "select * from (values", "select cast(pass_number as integer) as pass_number, critical, rows_after from (values"
    )
)
def pass_history(spark, sf) -> DataFrame:
    history = _passes(spark, sf).history_table()
    return history.select("pass_number", (F.col("critical") > 0).alias("critical"), "rows_after")


@query(
    f"""{DIRTY}, n as (select count(*) as rows from orders_dirty) select cast(row_number() over () as integer) as position, action, rows from (values ('drop_columns'), ('extract_units'), ('cast'), ('null_sentinels'), ('null_future_dates'), ('null_non_finite'), ('drop_missing_target')) t(action), n"""
)
def committed_steps(spark, sf) -> DataFrame:
    """The steps committed over all passes, as a table, beside the size of the table they came from."""
    df = view(spark, sf, "orders_dirty")
    steps = rc.steps_table(_passes(spark, sf).steps, df).select("position", "action")
    return steps.withColumn("rows", df.agg(F.count(F.lit(1))).scalar())


@query(
    f"""{DIRTY}, f as (select count(*) filter (where not coalesce(isfinite(amount), false)) as missing, count(*) filter (where isinf(amount)) as inf, count(*) filter (where amount = -1) as minus,
 count(*) filter (where {date_sql('order_date_s')} > timestamp '{AS_OF}') as future from orders_dirty)
 select cast(v.pass_number as integer) as pass_number, v.category, v.columns, v.status, v.rows_before from f, lateral (values
 (0, 'MISSING_DATA', 'amount', 'new', null), (1, 'MISSING_DATA', 'amount', 'repaired', missing), (0, 'OUTLIER', 'order_date_s', 'new', null), (1, 'OUTLIER', 'order_date_s', 'repaired', future)) v(pass_number, category, columns, status, rows_before)"""
)
def findings_ledger(spark, sf) -> DataFrame:
    """What the passes found against the pass before: the missing target and the future dates are repaired, and not reported again."""
    ledger = _passes(spark, sf).ledger_table()
    return ledger.where("category in ('MISSING_DATA', 'OUTLIER')").select("pass_number", "category", "columns", "status", "rows_before")


FOLD_SQL = """select *, case when rn <= floor(0.8 * n) then 'train' when rn <= floor(0.9 * n) then 'val' else 'test' end as fold from
 (select *, row_number() over (partition by {s} order by md5(cast(o_orderkey as varchar) || '42'), o_orderkey) as rn, count(*) over (partition by {s}) as n from {t})"""


@query(f"{DIRTY}, s as ({FOLD_SQL.format(s='status', t='orders_dirty')}), f as (select * exclude (rn, n) from s where fold <> 'train') {CLEANED.format(source='f')}".replace("priority, status from f", "priority, status, fold from f"))
def recipe_on_folds(spark, sf) -> DataFrame:
    """Committed steps replayed on the folds they were not made from."""
    _, val, test = three_way_split(view(spark, sf, "orders_dirty"), "o_orderkey", "status")
    out = None
    for name, fold in (("val", val), ("test", test)):
        one = readable(rc.replay(CLEANING, fold, "amount")).withColumn("fold", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
