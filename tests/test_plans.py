"""Recipes and feature rounds: lints, failures, leakage, replay."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltworks.operators import investigate as iv
from siltworks.operators.splitting import check_schema_drift, drop_declared
from siltworks.operators.training import detect_problem_type, fit_best, permutation_importance, preflight, problem_type, score
from siltworks.operators.violations import Rules
from siltworks.plans import feature_rounds as fr
from siltworks.plans.feature_rounds import FeatureStep
from siltworks.plans.passes import clean_in_passes
from siltworks.plans.benchmark import FEATURES_FAILED, GRAPH_FAILED, OK, REPLAY_FAILED, TRAINING_FAILED, Dataset, run, run_one
from siltworks.plans.fitted import FitState, fit_state
from siltworks.plans.recipe import RecipeError, Step, apply, lint, lint_table, ordered, replay
from siltworks.session import cut_lineage


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(1, 10.0, "a", 1.0), (2, -1.0, " b ", 2.0), (3, float("inf"), None, None), (4, None, "a", 4.0)], "id int, x double, c string, y double"
    )


def test_operation_spellings():
    assert Step(1, " drop_columns ", "drop_columns", "x").operation == "DROP_COLUMN"
    with pytest.raises(RecipeError):
        Step(1, "IMPUTE", "drop_columns", "x")
    with pytest.raises(RecipeError):
        Step(1, "CUSTOM_CODE", "scale", "x")


def test_failure_leaves_the_table_alone(table):
    steps = [Step(1, "CUSTOM_CODE", "trim", "c"), Step(2, "RENAME_COLUMN", "rename", "nope", {"to": "z"})]
    outcome = apply(steps, table)
    assert not outcome.ok and outcome.table is table
    assert [e["status"] for e in outcome.log] == ["SUCCESS", "FAILED"] and "nope" in outcome.error


def test_runtime_failure_leaves_the_table_alone(table):
    outcome = apply([Step(1, "CUSTOM_CODE", "expression", "c", {"sql": "cast(c as int)"})], table, cut_lineage)
    assert not outcome.ok and outcome.table is table and outcome.log[-1]["status"] == "FAILED"


def test_audit_counts_rows_after_each_step(table):
    steps = [Step(1, "CUSTOM_CODE", "null_non_finite", "x"), Step(2, "DROP_ROWS", "drop_missing_target", "x")]
    outcome = apply(steps, table, cut_lineage)
    assert [r["rows_after"] for r in outcome.audit().orderBy("step_id").collect()] == [4, 2]
    assert outcome.rollup().collect()[0].asDict() == {"status": "SUCCESS", "steps": 2}


@pytest.mark.parametrize(
    "step, words",
    [
        (Step(1, "DROP_COLUMN", "drop_columns", "y"), "drops or renames the target"),
        (Step(1, "RENAME_COLUMN", "rename", "y", {"to": "z"}), "drops or renames the target"),
        (Step(1, "DROP_ROWS", "drop_missing_target", "x"), "not the target"),
        (Step(1, "DROP_ROWS", "drop_rows", None, {"condition": "x is null"}), "drops rows on missing x"),
        (Step(1, "CUSTOM_CODE", "expression", "x", {"sql": "coalesce(x, 0)"}), "fills missing values"),
        (Step(1, "CUSTOM_CODE", "expression", "x", {"sql": "x / max(x) over ()"}), "statistics of the whole table"),
        (Step(1, "CUSTOM_CODE", "expression", "gone", {"sql": "x"}), "does not resolve"),
    ],
)
def test_lint_names_each_problem(table, step, words):
    assert any(words in p for p in lint([step], table, "y"))


@pytest.mark.parametrize(
    "step, rule",
    [
        (Step(1, "CUSTOM_CODE", "expression", "c", {"sql": "case when c is null then 'F' else c end"}), "fill"),
        (Step(1, "CUSTOM_CODE", "expression", "c", {"sql": "if(c <=> null, 'F', c)"}), "fill"),
        (Step(1, "CUSTOM_CODE", "expression", "c", {"sql": "concat_ws('', c)"}), "fill"),
        (Step(1, "CUSTOM_CODE", "expression", "x", {"sql": "x + rand()"}), "repeatable"),
        (Step(1, "CUSTOM_CODE", "expression", "x", {"sql": "case when current_timestamp() > '2020-01-01' then x end"}), "repeatable"),
        (Step(1, "CUSTOM_CODE", "expression", "y", {"sql": "concat('n', cast(y as string))"}), "target"),
        (Step(1, "CUSTOM_CODE", "expression", "y", {"sql": "x"}), "target"),
        (Step(1, "CUSTOM_CODE", "expression", "x", {"sql": "y"}), "replace"),
        (Step(1, "CUSTOM_CODE", "expression", "x", {"sql": "(x - 3.5) / 1.25"}), "scale"),
        (Step(1, "CUSTOM_CODE", "expression", "x", {"sql": "x / (select max(id) from range(5))"}), "whole table"),
        (Step(1, "DROP_ROWS", "drop_rows", None, {"condition": "isnull(x)"}), "row drop"),
        (Step(1, "DROP_ROWS", "drop_rows", None, {"condition": "coalesce(x, -5) < 0"}), "row drop"),
        (Step(1, "DROP_ROWS", "drop_rows", None, {"condition": "not (x is not null and y > 0)"}), "row drop"),
    ],
)
def test_lint_looks_through_other_spellings(table, step, rule):
    assert rule in {r["rule"] for r in lint_table([step], table, "y").collect()}


@pytest.mark.parametrize(
    "step",
    [
        Step(1, "CUSTOM_CODE", "expression", "x", {"sql": "case when x > 5 then null else x end"}),
        Step(1, "CUSTOM_CODE", "expression", "c", {"sql": "nullif(trim(c), '')"}),
        Step(1, "CUSTOM_CODE", "expression", "x", {"sql": "nullif(x, -1)"}),
        Step(1, "DROP_ROWS", "drop_rows", None, {"condition": "x > 5"}),
        Step(1, "DROP_ROWS", "drop_rows", None, {"condition": "y is null"}),
        Step(1, "CAST_TYPE", "cast", "c", {"to": "double"}),
        Step(1, "CUSTOM_CODE", "null_non_finite", "x"),
        Step(1, "CUSTOM_CODE", "null_outside", "x", {"low": 0.0}),
        Step(1, "DROP_ROWS", "drop_duplicates", None, {"keys": ["id"], "order": ["id"]}),
    ],
)
def test_lint_leaves_honest_steps_alone(table, step):
    assert lint([step], table, "y") == []


def test_lint_counts_what_a_step_touches(table):
    steps = [Step(1, "CUSTOM_CODE", "trim", "c"), Step(2, "DROP_ROWS", "drop_rows", None, {"condition": "isnull(c)"}), Step(3, "DROP_COLUMN", "drop_columns", "x")]
    got = {r["step_id"]: (r["rule"], r["rows_touched"]) for r in lint_table(steps, table, "y").collect()}
    assert got == {0: ("order", None), 1: ("none", 1), 2: ("row drop", 1), 3: ("none", 0)}


def test_feature_lints_read_the_plan(table):
    spark = table.sparkSession
    spark.udf.register("own", lambda v: v, "double")
    steps = [
        FeatureStep("packed", "CUSTOM_FEATURE", ("x",), {"sql": "to_json(struct(*))"}),
        FeatureStep("again", "CUSTOM_FEATURE", ("packed",), {"sql": "length(packed)"}),
        FeatureStep("noise", "CUSTOM_FEATURE", ("x",), {"sql": "uuid()"}),
        FeatureStep("hidden", "CUSTOM_FEATURE", ("x",), {"sql": "own(x)"}),
        FeatureStep("many", "CUSTOM_FEATURE", ("x",), {"sql": "explode(array(1, 2))"}),
        FeatureStep("c", "CUSTOM_FEATURE", ("x",), {"sql": "upper(c)"}),
        FeatureStep("fine", "CUSTOM_FEATURE", ("x",), {"sql": "x * 2"}),
    ]
    found = {}
    for p in fr.feature_problems(steps, table, "y"):
        found.setdefault(p.new_column, set()).add(p.rule)
    assert found == {"packed": {"leak"}, "noise": {"repeatable"}, "hidden": {"opaque"}, "many": {"row"}, "c": {"new"}}
    assert [s.new_column for s in fr.leakage_lint(steps[:2] + steps[-1:], table, "y")] == ["again", "fine"]


def test_lint_accepts_a_clean_recipe_in_order(table):
    steps = ordered([Step(0, "DROP_ROWS", "drop_missing_target", "y"), Step(0, "CUSTOM_CODE", "trim", "c"), Step(0, "DROP_COLUMN", "drop_columns", "id")])
    assert [s.action for s in steps] == ["drop_columns", "trim", "drop_missing_target"] and [s.step_id for s in steps] == [1, 2, 3]
    assert lint(steps, table, "y") == []
    assert any("not in order" in p for p in lint(list(reversed(steps)), table, "y"))


def test_paired_measurements(table):
    both = [Step(1, "CUSTOM_CODE", "null_outside", "x", {"low": 0.0}), Step(2, "CUSTOM_CODE", "null_outside", "y", {"low": 0.0})]
    assert any("pair" in p for p in lint(both, table, None, [("x", "y")], {"x"}))
    assert lint(both, table, None, [("x", "y")], {"x", "y"}) == []


def test_replay_needs_the_target(table):
    with pytest.raises(RecipeError):
        replay([Step(1, "DROP_COLUMN", "drop_columns", "y")], table, "y")


def test_leaks_are_found_by_what_they_read(table):
    steps = [
        FeatureStep("ok", "CUSTOM_FEATURE", ("x",), {"sql": "x + length('y')"}),
        FeatureStep("uses", "CUSTOM_FEATURE", ("x",), {"sql": "x + Y"}),
        FeatureStep("y", "NUMERIC_TRANSFORM", ("x",), {"kind": "abs"}),
        FeatureStep("source", "NUMERIC_TRANSFORM", ("y",), {"kind": "abs"}),
    ]
    assert [s.new_column for s in fr.leakage_lint(steps, table, "y")] == ["ok"]


def test_rounds_stop_where_they_should(table):
    good = FeatureStep("ax", "NUMERIC_TRANSFORM", ("x",), {"kind": "abs"})
    bad = FeatureStep("c", "TEXT_FEATURE", ("c",), {"kind": "length"})
    result = fr.run_rounds(table, "y", lambda df, n: [good] if n == 1 else [bad])
    assert result.table.columns == [*table.columns, "ax"] and [h["added"] for h in result.history] == [1, 0]
    leaky = fr.run_rounds(table, "y", lambda df, n: [FeatureStep("l", "NUMERIC_TRANSFORM", ("y",), {"kind": "abs"})])
    assert leaky.table.columns == table.columns and leaky.history[0]["kept"] == 0
    assert fr.run_rounds(table.select("y"), "y", lambda df, n: [good]).skipped
    assert fr.run_rounds(table.limit(0), "y", lambda df, n: [good]).skipped
    endless = fr.run_rounds(table, "y", lambda df, n: [FeatureStep(f"f{n}", "NUMERIC_TRANSFORM", ("x",), {"kind": "abs"})])
    assert len(endless.history) == 3


def test_training_frequencies_are_used_on_other_folds(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    other = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    step = FeatureStep("n", "CATEGORY_ENCODE", ("c",), {"kind": "frequency"})
    got = {r["c"]: r["n"] for r in fr.replay_features([step], other, fr.fit([step], train)).collect()}
    assert got == {"a": 2, "z": None, None: None}
    own = {r["c"]: r["n"] for r in fr.replay_features([step], train).collect()}
    assert own == {"a": 2, "b": 1}


@pytest.mark.parametrize("edge, label", [(0.0, None), (0.1, "lo"), (1.0, "lo"), (1.5, "hi"), (2.0, "hi"), (2.1, None)])
def test_bins_close_on_the_right(spark, edge, label):
    step = FeatureStep("b", "BINNING", ("v",), {"edges": [0.0, 1.0, 2.0], "labels": ["lo", "hi"]})
    assert step.apply(spark.createDataFrame([(edge,)], "v double")).first()["b"] == label


def test_questions_that_cannot_be_asked(table):
    for call in (
        lambda: iv.inspect_rows(table, "no_such = 1", "id"),
        lambda: iv.inspect_rows(table, "x = = 1", "id"),
        lambda: iv.cross_column_frequency(table, "c", "zz"),
        lambda: iv.histogram(table, "c"),
        lambda: iv.value_distribution(table.withColumn("e", F.lit(None).cast("double")), "e"),
        lambda: iv.value_distribution(table.withColumn("e", F.lit(float("inf"))), "e"),
        lambda: iv.correlation_scan(table, "c"),
    ):
        with pytest.raises(iv.InvestigationError):
            call()


def test_histogram_of_one_value(spark):
    out = iv.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in out] == [0, 0, 2, 0] and (out[0]["low"], out[-1]["high"]) == (2.5, 3.5)


def test_drift_and_declared_columns(table):
    check_schema_drift(table, table)
    with pytest.raises(ValueError, match="extra"):
        check_schema_drift(table, table.withColumn("new", F.lit(1)))
    with pytest.raises(ValueError):
        drop_declared(table, ["nope"])


def test_preflight_order(spark, table):
    first = lambda df, t: preflight(df, t).first()["error"]
    assert first(table, None) == "no target named"
    assert first(table, "zz") == "the table has no target column 'zz'"
    assert first(table, "x").startswith("4 rows where")
    many = spark.range(20).selectExpr("cast(1 as double) as one", "case when id < 9 then id * 1.0D end as few", "cast(id as double) as good")
    assert "never varies" in first(many, "one")
    assert first(many, "few").startswith("9 rows with a finite target")
    assert first(many, "good") is None


def test_task_names():
    assert problem_type("Binary Classification") == "binary" and problem_type("regression") == "regression"
    assert problem_type("clustering") is None and problem_type(None) is None


def test_a_model_learns_and_knows_why(spark):
    df = spark.range(600).selectExpr("id", "rand(3) as signal", "rand(4) as noise", "case when id % 4 = 0 then 'u' else 'v' end as text")
    df = df.withColumn("label", F.when(F.col("signal") > 0.5, "yes").otherwise("no"))
    df = cut_lineage(df)
    train, val, test = (df.where(c) for c in ("id % 10 < 7", "id % 10 in (7, 8)", "id % 10 = 9"))
    assert detect_problem_type(df, "label") == "binary"
    model = fit_best(train, val, "label", "binary_classification", "roc_auc", ignore=("id",))
    assert score(model, test, "roc_auc") > 0.95 and score(model, test, "accuracy") > 0.9 and score(model, test, "macro_f1") > 0.9
    assert len(model.leaderboard) == 3 and model.rows == 420 and model.labels == ["no", "yes"]
    importance = permutation_importance(model, val, "id")
    assert max(importance, key=importance.get) == "signal" and abs(importance["noise"]) < 0.2


def test_passes_leave_codes_alone(spark):
    codes = spark.range(1000).selectExpr("id", "case when id % 50 = 0 then concat(id, 'B') else concat('part-', id) end as code", "concat(id, case when id % 3 = 0 then ' kg' else '' end) as weight")
    result = clean_in_passes(codes, Rules())
    kept = result.table.selectExpr("count(code) as codes", "count(weight) as weights", "sum(weight) as total").first()
    assert (kept["codes"], kept["weights"], kept["total"]) == (1000, 1000, 499500.0)
    told = result.violations.where("affected_columns[0] = 'code' and subtype = 'UNIT_SUFFIX'").collect()
    assert [(v["severity"], v["n_rows"]) for v in told] == [("INFO", 20)]


@pytest.fixture(scope="module")
def labelled(spark):
    """A number to predict, a category with a gap, a sentinel, an identifier; key 1000 and more only in the test fold's reach."""
    return spark.range(600).selectExpr(
        "id", "concat('ref-', id) as ref", "case when id % 11 = 0 then 9999.0 else id % 50 end as x", "case when id % 7 = 0 then null else concat('g', id % 5) end as g",
        "cast(id % 50 as double) * 3 + pmod(xxhash64(id), 10) as y",
    )


def dataset(frame, **more):
    return Dataset("made", lambda spark: frame, "y", "regression", "rmse", "id", **({"rules": Rules(sentinels={"x": [9999.0]}), "features": []} | more))


def failing_on(frame, fold: int, column: str = "x"):
    """A condition that is true for the rows of one fold only."""
    from siltworks.operators.splitting import three_way_split

    ids = sorted(r["id"] for r in three_way_split(frame, "id")[fold].select("id").collect())
    return f"case when id = {ids[0]} then cast('no number' as double) else {column} end"


def test_stages_of_a_run(labelled, spark):
    done = run_one(spark, dataset(labelled))
    assert done.result["status"] == OK and done.result["test_score"] > 0
    assert [(s[2], s[3]) for s in done.stages] == [(n, OK) for n in ("split", "fit", "replay", "features", "train", "score")]
    assert [s[4] for s in done.stages][0] == 600 and done.result["n_train"] == 480 == done.stages[1][4]


def test_replays_that_fail_are_told_apart(labelled, spark):
    bad_step = Step(1, "CUSTOM_CODE", "expression", "x", {"sql": failing_on(labelled, 2)})
    assert run_one(spark, dataset(labelled, steps=[bad_step])).result["status"] == REPLAY_FAILED
    bad_feature = FeatureStep("z", "CUSTOM_FEATURE", ("x",), {"sql": failing_on(labelled, 2)})
    assert run_one(spark, dataset(labelled, features=[bad_feature])).result["status"] == FEATURES_FAILED
    assert run_one(spark, dataset(labelled.limit(0))).result["status"] == TRAINING_FAILED
    assert run_one(spark, Dataset("made", lambda s: labelled, "nothing", "regression", "rmse", "id")).result["status"] == GRAPH_FAILED
    unknown = Dataset("made", lambda s: labelled, "y", "regression", "no_such_metric", "id", features=[])
    assert run_one(spark, unknown).result["status"] == TRAINING_FAILED
    both = [dataset(labelled, steps=[bad_step]), unknown]
    assert [r["status"] for r in run(spark, both).collect()] == [REPLAY_FAILED, TRAINING_FAILED]


def test_no_test_row_reaches_the_fit(labelled, spark):
    """Whatever stands in the other folds, what is learnt stays the same."""
    from siltworks.operators.splitting import assign_folds

    marked = assign_folds(labelled, "id")
    other = marked.selectExpr("id", "ref", "case when fold = 'train' then x else -77777 end as x", "case when fold = 'train' then g else concat('new', id) end as g", "case when fold = 'train' then y else -1 end as y")
    states = []
    for frame in (labelled, other):
        train = assign_folds(frame, "id").where("fold = 'train'").drop("fold")
        fitted = fit_state(train, "y", "id", Rules(sentinels={"x": [9999.0]}), features=[FeatureStep("gn", "CATEGORY_ENCODE", ("g",), {"kind": "frequency"})])
        states.append((fitted.state.steps, fitted.state.dropped, fitted.state.features, sorted(map(tuple, fitted.state.counts["g"].collect()))))
    assert states[0] == states[1] and "ref" in states[0][1] and states[0][3]


def test_fit_state_survives_writing(labelled, spark, tmp_path):
    fitted = fit_state(labelled, "y", "id", Rules(sentinels={"x": [9999.0]}), features=[FeatureStep("gn", "CATEGORY_ENCODE", ("g",), {"kind": "frequency"}), FeatureStep("b", "BINNING", ("x",), {"edges": [0.0, 10.0, 60.0]})])
    fitted.state.save(spark, str(tmp_path / "state"))
    again = FitState.load(spark, str(tmp_path / "state"))
    assert (again.steps, again.dropped, again.features) == (fitted.state.steps, fitted.state.dropped, fitted.state.features)
    want = fitted.state.transform(labelled).orderBy("id").collect()
    assert again.transform(labelled).orderBy("id").collect() == want and len(want) == 600
