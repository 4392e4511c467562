"""Checks of wide tables in several scans, and rows that travel once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltworks.operators import cleaning, skew, violations


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_checks_are_the_same_in_any_number_of_scans(spark, monkeypatch, chunk):
    df = spark.createDataFrame([(i, i % 3, None if i % 4 else "x") for i in range(60)], "a long, b long, c string")
    checks = [violations.Check("RANGE", "INFO", [c], F.col(c) > 1, f"{c} above one", "look", share=0.3) for c in "ab"]
    checks += [violations.Check("NULLS", "CRITICAL", ["c"], F.col("c").isNull(), "c is null", "fill"), violations.Check("NEVER", "INFO", ["a"], F.col("a") < 0, "below", "look")]
    checks += [violations.Check("GATED", "INFO", ["b"], F.col("b") == 0, "b is zero", "look", gate=(F.col("a") >= 0, 0.5), below=below) for below in (False, True)]
    want = [(1, "RANGE", 58), (2, "RANGE", 20), (3, "NULLS", 45), (5, "GATED", 20)]
    monkeypatch.setattr(violations, "CHECK_CHUNK", chunk)
    got = violations.run_checks(df, checks)
    assert [(r["violation_id"], r["category"], r["n_rows"]) for r in got.orderBy("violation_id").collect()] == want
    assert violations.run_checks(df.limit(0), checks).count() == 0


def test_a_scan_reads_the_columns_of_its_checks_only(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(10).select(*[F.col("id").alias(f"c{i}") for i in range(violations.CHECK_CHUNK * 2)]).write.parquet(path)
    df = spark.read.parquet(path)
    got = violations.run_checks(df, [violations.Check("RANGE", "INFO", [c], F.col(c) > 7, c, "look") for c in df.columns])
    assert got.count() == len(df.columns)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2


def test_duplicates_by_key_have_one_answer(spark):
    rows = [(1, 5, "b"), (1, 5, "a"), (1, 6, "a"), (2, None, "x"), (2, 1, "x"), (None, 1, None), (None, 1, None)]
    df = spark.createDataFrame(rows, "k long, v long, t string").repartition(5)
    kept = cleaning.drop_duplicate_rows(df, ["k"], ["v"])
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, 5, "a"), (2, None, "x"), (None, 1, None)], key=repr)
    assert cleaning.drop_duplicate_rows(df).count() == 6 and cleaning.drop_duplicate_rows(df.limit(0)).count() == 0
    mapped = df.withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    assert cleaning.drop_duplicate_rows(mapped, ["k"], ["v"]).select("k", "v", "t").exceptAll(kept).count() == 0
    dotted = df.withColumnRenamed("t", "t.x")
    assert cleaning.drop_duplicate_rows(dotted, ["k"]).columns == ["k", "v", "t.x"]


def test_a_long_value_is_looked_up_by_shuffle(spark):
    long = "y" * (skew.KEY_BYTES + 1)
    df = spark.createDataFrame([(i % 7,) for i in range(700)], "key long")
    lookup = spark.createDataFrame([(k, 100, long if k == 3 else f"v{k}") for k in range(6)], "key long, n long, v string")
    got = skew.skew_safe_lookup(df, lookup, "key", "n", "v", salts=4, limit=2)
    assert {(r["key"], r["v"], r["n"]) for r in got.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n")).collect()} == {(k, long if k == 3 else f"v{k}" if k < 6 else None, 100) for k in range(7)}
