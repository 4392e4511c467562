"""Frequent values by sketch and recount, the profile without value shuffles, and verified near copies."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltworks.operators import heavy as hv
from siltworks.operators import profiling as pr
from siltworks.operators.frequency import LONG_VALUE, top_values, value_key
from siltworks.operators.near_copies import verified_near_copies


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(30_000).selectExpr(
        "case when id % 3 = 0 then 'hot' when id % 7 = 0 then 'warm' when id % 11 = 0 then repeat('long ', 80) else concat('v', id) end as s",
        "cast(sqrt(id) as int) as i", "id as unique", "case when id % 2 = 0 then 1.5 when id % 5 = 0 then double('NaN') else id end as d", "cast(null as string) as nothing",
    ).repartition(6)


@pytest.mark.parametrize("tracked", [64, 4096])
def test_recounted_tops_are_the_exact_ones(skewed, tracked):
    want = rows(top_values(skewed, k=4).select("column", "rank", "value", "n"))
    assert rows(hv.top_values_by_recount(skewed, k=4, tracked=tracked)) == want


def test_only_what_is_proven_is_called_proven(skewed):
    pairs = skewed.select(F.lit("s").alias("column"), F.col("s").alias("value")).where("value is not null")
    top = hv.heavy_top(pairs, 3).collect()
    assert [r["value"] for r in sorted(top, key=lambda r: r["rank"])][:2] == ["hot", "warm"] and all(r["proven"] for r in top)
    unique = skewed.select(F.lit("u").alias("column"), F.col("unique").alias("value"))
    assert not any(r["proven"] for r in hv.heavy_top(unique, 3).collect())
    few = skewed.select(F.lit("f").alias("column"), (F.col("i") % 2).alias("value"))
    assert [r["proven"] for r in hv.heavy_top(few, 5).collect()] == [True, True]


def test_long_values_are_ordered_by_their_text(spark):
    texts = ["b" * 300, "a" * 400, "a" * 300, "c"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["value"] for r in top_values(frame, k=4).orderBy("rank").collect()] == sorted(texts)
    keys = frame.select(value_key(F.col("t")).alias("k")).collect()
    assert all(len(r["k"]) == (1 if i == 3 else LONG_VALUE + 32) for i, r in enumerate(keys))


def exchanges(frame) -> list[str]:
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]


def test_cheap_profile_shuffles_no_values(spark, small, skewed, monkeypatch):
    seen = []
    original = pr.typed_frequencies
    monkeypatch.setattr(pr, "typed_frequencies", lambda *a, **k: seen.append(1) or original(*a, **k))
    cheap = pr.profile(skewed, pr.ProfileOptions(exact=False))
    got = {r["column"]: r for r in cheap.collect()}
    assert not seen
    exact = {r["column"]: r for r in pr.profile(skewed, pr.ProfileOptions()).collect()}
    assert seen
    for c, r in got.items():
        e = exact[c]
        assert (r["row_count"], r["non_null"], r["min"], r["max"]) == (e["row_count"], e["non_null"], e["min"], e["max"])
        assert abs(r["unique_count"] - e["unique_count"]) <= 0.1 * e["unique_count"] + 1
    assert [(v["value"], v["count"]) for v in got["s"]["top_values"]][:3] == [(v["value"], v["count"]) for v in exact["s"]["top_values"]][:3]
    assert got["s"]["top_count"] == exact["s"]["top_count"] and got["s"]["dominant_pattern"] == exact["s"]["dominant_pattern"]
    assert set(got["s"]["samples"]) <= {r["s"] for r in skewed.select("s").distinct().collect()}
    # Values cross the network only as the candidates' counts, beside one row per column or bucket.
    assert all("column" in line for line in exchanges(cheap))


def words(rng, n):
    return [rng.choice("river stone garden window letter market winter paper silver forest travel morning story music".split()) + str(rng.randrange(40)) for _ in range(n)]


def triples(text):
    w = text.split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_near_copies_are_verified(spark):
    rng = random.Random(3)
    texts = {}
    for group in range(12):
        base = words(rng, 80)
        for _ in range(rng.choice([1, 3, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(80)] = "edited" + str(rng.randrange(1000))
            texts[len(texts)] = " ".join(copy)
    shared = words(rng, 25)
    for _ in range(60):
        texts[len(texts)] = " ".join(shared + words(rng, 60))
    frame = spark.createDataFrame([*texts.items(), (9001, None), (9002, ""), (9003, "two words")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in verified_near_copies(frame.repartition(4), "doc_id", "text").collect()}
    for k, r in got.items():
        a, b = triples(texts[k]), triples(texts[r["anchor"]])
        assert (r["shared"], r["united"]) == (len(a & b), len(a | b)) and r["similarity"] >= 0.8 and r["anchor"] < k
    near = {k for k in texts for j in texts if j < k and len(triples(texts[k]) & triples(texts[j])) >= 0.97 * len(triples(texts[k]) | triples(texts[j]))}
    assert len(near & set(got)) >= 0.95 * len(near) and near
    assert not set(got) - {k for k in texts for j in texts if j < k and len(triples(texts[k]) & triples(texts[j])) >= 0.8 * len(triples(texts[k]) | triples(texts[j]))}


def test_one_large_cluster_takes_one_round(spark):
    frame = spark.range(400).selectExpr("id", "concat('the same words over and over again in every row of it ', if(id < 200, '', 'but these'), ' end') as t")
    got = verified_near_copies(frame, "id", "t", rounds=2)
    assert got.groupBy("anchor").count().orderBy("anchor").collect() == [(0, 199), (200, 199)]
