"""Split, train, score (family K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.catalog.cleaning_queries import CLEANING, FOLD_SQL
from siltworks.catalog.registry import Family
from siltworks.catalog.views import AS_OF, ctes, table, view
from siltworks.operators import scoring as sc
from siltworks.operators import splitting as sp
from siltworks.operators import training as tr
from siltworks.plans import benchmark as bm
from siltworks.operators.violations import Rules
from siltworks.plans.feature_rounds import FeatureStep
from siltworks.plans.run import run_table

family = Family()
QUERIES, ORACLES = family.queries, family.oracles
query = family.query


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def drop_declared_columns(spark, sf) -> DataFrame:
    return sp.drop_declared(table(spark, sf, "orders"), ["o_totalprice", "o_orderdate"])


@query(f"select o_orderkey, o_orderstatus, fold from ({FOLD_SQL.format(s='o_orderstatus', t='orders')})")
def stratified_split(spark, sf) -> DataFrame:
    return sp.assign_folds(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query(f"{ctes('orders_dirty')} select status, fold, count(*) as n from ({FOLD_SQL.format(s='status', t='orders_dirty')}) group by all")
def stratified_split_rare_class(spark, sf) -> DataFrame:
    """A class of a few rows keeps its shares too."""
    return sp.assign_folds(view(spark, sf, "orders_dirty").select("o_orderkey", "status"), "o_orderkey", "status").groupBy("status", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select event_id, case when rn <= floor(0.8 * n) then 'train' when rn <= floor(0.9 * n) then 'val' else 'test' end as fold from
 (select event_id, row_number() over (order by md5(cast(event_id as varchar) || '7'), event_id) as rn, count(*) over () as n from events)"""
)
def plain_split(spark, sf) -> DataFrame:
    return sp.assign_folds(table(spark, sf, "events").select("event_id"), "event_id", seed=7)


@query(
    f"""{ctes('orders_dirty')} select 'amount' as target, null::varchar as error, count(*) as rows, count(*) filter (where isfinite(amount)) as usable_rows, count(*) filter (where not coalesce(isfinite(amount), false)) as dropped_rows from orders_dirty
 union all select 'one_value', 'target ''one_value'' never varies', count(*), count(*), 0 from orders_dirty
 union all select 'nothing', 'the table has no target column ''nothing''', null, null, null"""
)
def training_preflight(spark, sf) -> DataFrame:
    df = view(spark, sf, "orders_dirty").withColumn("one_value", F.lit(1))
    out = None
    for target in ("amount", "one_value", "nothing"):
        one = tr.preflight(df, target).select(F.lit(target).alias("target"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{ctes('orders_dirty')} select o_orderkey, amount from orders_dirty where isfinite(amount)")
def drop_invalid_target(spark, sf) -> DataFrame:
    return tr.drop_invalid_target(view(spark, sf, "orders_dirty"), "amount").select("o_orderkey", "amount")


@query(
    """select 'toxic' as target, 'binary' as problem, count(toxic) as rows from labels union all select 'l_returnflag', 'multiclass', count(l_returnflag) from lineitem
 union all select 'o_totalprice', 'regression', count(o_totalprice) from orders"""
)
def problem_types(spark, sf) -> DataFrame:
    """Detected from the target where the task is not named."""
    out = None
    for name, target in (("labels", "toxic"), ("lineitem", "l_returnflag"), ("orders", "o_totalprice")):
        df = table(spark, sf, name)
        one = df.agg(F.count(target).alias("rows")).select(F.lit(target).alias("target"), F.lit(tr.detect_problem_type(df, target)).alias("problem"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def auc_sql(label: str, score: str, source: str) -> str:
    return f"""select (sum(case when y then r end) - p * (p + 1) / 2.0::double) / (p * 1.0::double * (n - p)) as auc from
 (select {label} as y, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0::double as r, count(*) filter (where {label}) over () as p, count(*) over () as n from {source}) group by p, n"""


@query(f"select round(auc, 9) as roc_auc from ({auc_sql(chr(39).join(['l_returnflag = ', 'R', '']), 'l_quantity', 'lineitem')})")
def roc_auc(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").alias("label"), F.col("l_quantity").alias("score"))
    return sc.roc_auc(df, "label", "score").select(F.round("roc_auc", 9).alias("roc_auc"))


_CLASS_SCORES = {"A": "l_quantity", "N": "l_tax", "R": "l_extendedprice"}


@query("select round(avg(auc), 9) as roc_auc from (" + " union all ".join(f"""({auc_sql(f"l_returnflag = '{k}'", c, 'lineitem')})""" for k, c in _CLASS_SCORES.items()) + ")")
def roc_auc_multiclass(spark, sf) -> DataFrame:
    return sc.roc_auc_ovr(table(spark, sf, "lineitem"), "l_returnflag", _CLASS_SCORES).select(F.round("roc_auc", 9).alias("roc_auc"))


_PREDICTED = "case when l_quantity > 30 then 'R' when l_linestatus = 'O' then 'N' else 'A' end"
_F1 = f"""with s as (select l_returnflag as y, {_PREDICTED} as p from lineitem), c as (select distinct y as k from s union select distinct p from s),
 f as (select k, count(*) filter (where y = k and p = k) as tp, count(*) filter (where y <> k and p = k) as fp, count(*) filter (where y = k and p <> k) as fn from c, s group by k)"""


def predicted(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_returnflag as label", f"{_PREDICTED} as prediction")


@query(_F1 + " select k as class, tp, fp, fn, round(2.0::double * tp / (2 * tp + fp + fn), 9) as f1 from f")
def class_f1(spark, sf) -> DataFrame:
    return sc.class_f1(predicted(spark, sf), "label", "prediction").withColumn("f1", F.round("f1", 9))


@query(_F1 + " select round(avg(2.0::double * tp / (2 * tp + fp + fn)), 9) as macro_f1 from f")
def macro_f1(spark, sf) -> DataFrame:
    return sc.macro_f1(predicted(spark, sf), "label", "prediction").select(F.round("macro_f1", 9).alias("macro_f1"))


@query(f"select round(avg(case when l_returnflag = {_PREDICTED} then 1.0::double else 0 end), 9) as accuracy from lineitem")
def accuracy(spark, sf) -> DataFrame:
    return sc.accuracy(predicted(spark, sf), "label", "prediction").select(F.round("accuracy", 9).alias("accuracy"))


@query("select round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)), 4) as rmse from lineitem")
def rmse(spark, sf) -> DataFrame:
    df = table(spark, sf, "lineitem").selectExpr("l_extendedprice as y", "l_quantity * 1500 as p")
    return sc.rmse(df, "y", "p").select(F.round("rmse", 4).alias("rmse"))


def _labelled(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


@query()
def model_selection(spark, sf) -> DataFrame:
    """Candidates fitted on the training fold, ranked on the validation fold."""
    train, val, _ = sp.three_way_split(_labelled(spark, sf), "doc_id", "quality")
    model = tr.fit_best(train, val, "quality", "Binary Classification", ignore=("doc_id",))
    return spark.createDataFrame([(n, v) for n, v, _ in model.leaderboard], "model string, score_val double")


@query()
def model_report(spark, sf) -> DataFrame:
    """Metadata of a regression model with its permutation importance."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    train, val, _ = sp.three_way_split(df, "o_orderkey")
    model = tr.fit_best(train, val, "o_totalprice", "regression", ignore=("o_orderkey",))
    model.importance = tr.permutation_importance(model, val, "o_orderkey")
    return tr.model_metadata(model, df).drop("training_time_seconds")


@query()
def whole_run(spark, sf) -> DataFrame:
    """From a raw table and a question to a scored model."""
    df = view(spark, sf, "orders_dirty").drop("amount_s")
    report = run_table(df, "o_orderkey", "What drives the amount?", rules=Rules(as_of=AS_OF, sentinels={"amount": [-1.0, 9999.0]}), task_type="regression")
    return report.model.select(
        "target_column", "best_model", "num_rows_trained", "num_features", F.lit(",".join(report.dropped)).alias("dropped"), F.lit(report.test_score).alias("test_score")
    )


REGISTRY = [
    bm.Dataset(
        "documents",
        lambda spark, sf: _labelled(spark, sf),
        "toxic",
        "binary_classification",
        "roc_auc",
        "doc_id",
        drop=["quality"],
        features=[FeatureStep("source_frequency", "CATEGORY_ENCODE", ("source",), {"kind": "frequency"})],
        baseline=0.5,
    ),
    bm.Dataset("orders", lambda spark, sf: view(spark, sf, "orders_dirty"), "amount", "regression", "rmse", "o_orderkey", drop=["amount_s"], steps=[s for s in CLEANING if s.column != "amount_s"], features=[]),
    bm.Dataset("broken", lambda spark, sf: table(spark, sf, "orders"), "o_orderstatus", "multiclass_classification", "macro_f1", "o_orderkey", drop=["no_such_column"]),
]


@query()
def benchmark_runs(spark, sf) -> DataFrame:
    """A registry of labelled tables from split to held-out score; the broken entry does not stop the others."""
    bound = [bm.Dataset(**{**vars(d), "load": lambda s, d=d: d.load(s, sf)}) for d in REGISTRY]
    return bm.formatted(bm.run(spark, bound))


@query(
    f"""select fold, case fold when 'val' then 'late' else '' end as extra, case fold when 'val' then '' else 'o_totalprice' end as missing, count(*) as rows
 from ({FOLD_SQL.format(s='o_orderstatus', t='orders')}) where fold <> 'train' group by 1"""
)
def schema_drift(spark, sf) -> DataFrame:
    """Columns that a replayed fold has too many or too few against the training fold, beside its rows."""
    train, val, test = sp.three_way_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", "o_orderstatus")
    out = None
    for name, fold in (("val", val.withColumn("late", F.col("o_totalprice") > 0)), ("test", test.drop("o_totalprice"))):
        extra, missing = sp.schema_drift(train, fold)
        one = fold.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("fold"), F.lit(",".join(extra)).alias("extra"), F.lit(",".join(missing)).alias("missing"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


_FOLDS = {
    "documents": FOLD_SQL.format(s="toxic", t="labelled").replace("o_orderkey", "doc_id"),
    "orders": FOLD_SQL.format(s="1", t="orders_dirty"),
}


@query(
    f"""{ctes('orders_dirty')}, labelled as (select doc_id, toxic from documents join labels using (doc_id)),
 d as (select 'documents' as name, fold, true as usable from ({_FOLDS['documents']})),
 o as (select 'orders' as name, fold, coalesce(amount not in (-1, 9999) and isfinite(amount), false) as usable from ({_FOLDS['orders']})),
 f as (select * from d union all select * from o),
 c as (select name, count(*) as whole, count(*) filter (where fold = 'train' and usable) as train, count(*) filter (where fold <> 'train' and usable) as rest, count(*) filter (where fold = 'test' and usable) as test from f group by 1)
 select name, v.position, v.stage, 'ok' as status, v.rows from c, lateral (values (1, 'split', whole), (2, 'fit', train), (3, 'replay', rest), (4, 'features', rest), (5, 'train', train), (6, 'score', test)) v(position, stage, rows)
 union all select 'broken', 1, 'split', 'graph_failed', null"""
)
def benchmark_stages(spark, sf) -> DataFrame:
    """How far each dataset came and how many rows each stage left: only the training fold is fitted on."""
    bound = [bm.Dataset(**{**vars(d), "load": lambda s, d=d: d.load(s, sf)}) for d in REGISTRY]
    return bm.run_stages(spark, bound).select("name", "position", "stage", "status", "rows")
