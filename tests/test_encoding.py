"""Text features fitted on the training fold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.operators.encoding import SMOOTHING, fit_categories
from siltworks.operators.training import few_values, fit_best, score


def test_slots_follow_the_counted_cardinality(spark):
    train = spark.range(20_000).selectExpr("concat('v', id % 5000) as many", "concat('w', id % 7) as few", "'same' as one", "cast(id % 5000 as double) as y")
    got = fit_categories(train, ["many", "few", "one"], "y")
    assert got.cardinality == {"many": 5000, "few": 7, "one": 1}
    assert got.width == {"few": 8, "one": 2, "many": 1} and got.outputs == ["few_slots", "one_slots", "many_mean0"]
    row = got.transform(spark.createDataFrame([("v17", "w3", "same"), ("unseen", "unseen", "unseen")], "many string, few string, one string")).orderBy(F.desc("few")).collect()
    seen, unseen = {r["many"]: r for r in row}["v17"], {r["many"]: r for r in row}["unseen"]
    assert seen["few_slots"].size == 8 and sum(seen["few_slots"].toArray()) == 1
    assert list(unseen["few_slots"].toArray()) == [0] * 7 + [1]
    prior = 2499.5
    assert unseen["many_mean0"] == prior and seen["many_mean0"] == pytest.approx((4 * 17 + SMOOTHING * prior) / (4 + SMOOTHING))


def test_training_rows_leave_themselves_out(spark):
    rows = [(f"v{i}", float(i % 2)) for i in range(100)] + [("v0", 1.0)]
    train = spark.createDataFrame(rows, "c string, y double")
    got = fit_categories(train, ["c"], "y", slots=3)
    out = got.transform(train, "y").collect()
    prior = np.mean([y for _, y in rows])
    for r in out:
        others = [y for c, y in rows if c == r["c"]]
        want = (sum(others) - r["y"] + SMOOTHING * prior) / (len(others) - 1 + SMOOTHING)
        assert r["c_mean0"] == pytest.approx(want)


def test_classes_have_a_mean_each(spark):
    train = spark.range(3000).selectExpr("concat('v', id % 300) as c", "case when id % 300 < 100 then 'a' when id % 300 < 200 then 'b' else 'd' end as y")
    got = fit_categories(train, ["c"], "y", ["a", "b", "d"])
    assert got.width == {"c": 3}
    r = got.transform(train.where("c = 'v150'").limit(1)).first()
    assert r["c_mean1"] > 0.5 > r["c_mean0"] and r["c_mean0"] + r["c_mean1"] + r["c_mean2"] == pytest.approx(1.0)
    two = fit_categories(train.withColumn("z", F.when(F.col("y") == "a", "no").otherwise("yes")), ["c"], "z", ["no", "yes"])
    assert two.width == {"c": 1} and two.classes == ["yes"]


def test_five_thousand_categories_are_told_apart(spark):
    """Every category has its own level: shared slots would blur them, the encoding does not."""
    frame = spark.range(40_000).selectExpr("id", "concat('c', pmod(xxhash64(id), 5000)) as c", "cast(pmod(xxhash64(pmod(xxhash64(id), 5000), 3), 1000) as double) as y")
    train, val = frame.where("id % 10 < 8"), frame.where("id % 10 = 8")
    model = fit_best(train, val, "y", "regression", ignore=("id",))
    assert min(model.encoding.cardinality.values()) > 4900
    spread = frame.agg(F.stddev("y")).first()[0]
    assert score(model, frame.where("id % 10 = 9"), "rmse") < 0.8 * spread


def test_few_values_are_counted_and_many_are_not(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 as three", "cast(null as int) as nothing")
    assert few_values(df, "three", 20) == 3 and few_values(df, "id", 20) == 21 and few_values(df, "nothing", 20) == 0
