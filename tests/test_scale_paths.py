"""The ways taken for hot groups and large columns give what the plain ways give."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.operators import runlog as rl
from siltworks.operators import skew as sk
from siltworks.operators.quantiles import exact_quantiles, sketch_quantiles
from siltworks.operators.scoring import auc_by_group
from siltworks.operators.splitting import assign_folds, three_way_split


@pytest.fixture(scope="module")
def log(spark):
    """Half of the rows in one session, ties in time, and a second hot one."""
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        session = 0 if rng.random() < 0.5 else rng.choice([1, 1, 2, 3, 4, 5, 6])
        rows.append((session, i, 1_700_000_000_000 + (i // 3) * 1000, rng.choice(["start", "end", "error", "ok"]), f"n{rng.randrange(3)}", rng.random()))
    frame = spark.createDataFrame(rows, "session int, seq long, ms long, kind string, node string, value double")
    return frame.withColumn("ts", F.timestamp_millis("ms")).repartition(6).persist()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_row_numbers_of_hot_groups(log):
    order = ["ms", "seq"]
    want = log.withColumn("rn", F.row_number().over(W.partitionBy("session").orderBy(*order)).cast("long"))
    got = sk.row_numbers(log, ["session"], order, "rn", F.col("ms").cast("double"), hot_rows=200)
    assert rows(got.select("session", "seq", "rn")) == rows(want.select("session", "seq", "rn"))


def test_slices_cut_hot_groups_only(log):
    sliced, hot = sk.slice_hot_groups(log, ["session"], F.col("seq").cast("double"), 500)
    assert hot
    sizes = {r["session"]: r["n"] for r in sliced.groupBy("session").agg(F.count_distinct("_slice").alias("n")).collect()}
    counts = {r["session"]: r["count"] for r in log.groupBy("session").count().collect()}
    for session, n in counts.items():
        assert (sizes[session] > 1) == (n > 500)
    largest = sliced.groupBy("session", "_slice").count().agg(F.max("count")).first()[0]
    assert largest < 900


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbour_across_slices(log, ahead):
    w = W.partitionBy("session").orderBy("seq")
    want = log.withColumn("x", (F.lead if ahead else F.lag)("node").over(w))
    got = sk.neighbour(log, ["session"], ["seq"], F.col("seq").cast("double"), F.col("node"), "x", ahead, hot_rows=150)
    assert rows(got.select("session", "seq", "x")) == rows(want.select("session", "seq", "x"))


def test_running_values_across_slices(log):
    w = W.partitionBy("session").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    flag = (F.col("kind") == "error").cast("long")
    start = F.when(F.col("kind") == "start", F.col("seq"))
    want = log.withColumns({"s": F.sum(flag).over(w), "m": F.max(start).over(w)})
    got = sk.running_before(log, ["session"], ["seq"], F.col("seq").cast("double"), {"s": ("sum", flag), "m": ("max", start)}, hot_rows=150)
    assert rows(got.select("session", "seq", "s", "m")) == rows(want.select("session", "seq", "s", "m"))


def paired_by_hand(frame: pd.DataFrame) -> dict[int, int | None]:
    out, open_since = {}, {}
    for r in frame.sort_values("seq").itertuples():
        if r.kind == "start":
            open_since[(r.session, r.node)] = r.ms
        elif r.kind == "end":
            began = open_since.pop((r.session, r.node), None)
            out[r.seq] = None if began is None else r.ms - began
    return out


@pytest.mark.parametrize("hot_rows", [60, 10**9])
def test_node_durations_equal_plain_pairing(log, hot_rows):
    want = paired_by_hand(log.toPandas())
    got = rl.node_spans(log, "session", "node", "seq", "ts", F.col("kind") == "start", F.col("kind") == "end", hot_rows).collect()
    assert {r["seq"]: r["duration_ms"] for r in got} == want


@pytest.mark.parametrize("hot_rows", [60, 10**9])
def test_retries_equal_plain_runs(log, hot_rows):
    runs, current = [], {}
    for r in log.toPandas().sort_values("seq").itertuples():
        key = (r.session, r.node)
        if r.kind == "error":
            current.setdefault(key, []).append(r.seq)
        elif key in current:
            failed = current.pop(key)
            runs.append((*key, failed[0], len(failed) + 1, True))
    runs += [(*key, failed[0], len(failed), False) for key, failed in current.items()]
    got = rl.retry_sequences(log, "session", "node", "seq", "ts", F.col("kind") == "error", hot_rows)
    assert rows(got.select("session", "node", "first_seq", "attempts", "succeeded")) == sorted(runs, key=str)


@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_pass_brackets_do_not_depend_on_slices(log, hot_rows):
    frame = rl.pass_brackets(log, "session", "seq", "ts", F.col("kind") == "start", F.col("kind") == "ok", F.col("kind") == "error", hot_rows)
    passes = frame.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("pass").alias("last"))
    starts = log.where("kind = 'start'").groupBy("session").agg(F.count(F.lit(1)).alias("starts"))
    joined = passes.join(starts, "session").collect()
    assert joined and all(r["n"] == r["last"] == r["starts"] for r in joined)
    assert frame.where("exited < entered").count() == 0


def test_lookup_with_heavy_and_null_keys(spark, log):
    keyed = log.select("seq", F.when(F.col("seq") % 5 == 0, None).when(F.col("seq") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("seq") % 700)).alias("key"))
    counts = keyed.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("n"))
    want = rows(keyed.join(counts.select("key", "v"), "key", "left").select("seq", "key", "v"))
    for limit in (10, 100_000):
        got = sk.skew_safe_lookup(keyed, counts, "key", "n", "v", salts=16, limit=limit)
        assert rows(got.select("seq", "key", "v")) == want


def test_lookup_beyond_the_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(sk, "HOT_KEYS", 3)
    df = spark.range(500).selectExpr("id", "cast(sqrt(id) as int) as key")
    counts = df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("n") * 2)
    got = sk.skew_safe_lookup(df, counts, "key", "n", "v", salts=4, limit=5)
    assert rows(got.select("id", "v")) == rows(df.join(counts, "key").select("id", "v"))


@pytest.mark.parametrize("hot_rows", [50, 10**9])
def test_auc_counts_every_pair(spark, hot_rows):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": rng.integers(0, 2, 900), "y": rng.random(900) < 0.3, "s": np.round(rng.random(900), 2)})
    got = {r["g"]: r["auc"] for r in auc_by_group(spark.createDataFrame(frame), "g", F.col("y"), "s", hot_rows).collect()}
    for g, part in frame.groupby("g"):
        pos, neg = part.s[part.y].to_numpy(), part.s[~part.y].to_numpy()
        wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        assert got[g] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)


@pytest.mark.parametrize("shape", ["normal", "ties", "heavy", "constant", "two", "one"])
def test_quantiles_by_bracketing(spark, shape):
    rng = np.random.default_rng(11)
    n = 3000
    x = {
        "normal": rng.normal(size=n), "ties": rng.integers(0, 12, n).astype(float), "heavy": np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n)),
        "constant": np.full(500, 2.5), "two": np.array([3.0, -1.0]), "one": np.array([4.0]),
    }[shape]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(5)
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    found = []
    for inside, size, slack in ((10, 8, 0.2), (50, 32, 0.06), (10**9, 4096, 0.004), (10, 8, 0.0)):
        got = exact_quantiles(df, {"x": F.col("x")}, probabilities, inside, size, slack)["x"]
        assert got == pytest.approx(list(np.quantile(x, probabilities)), abs=1e-12)
        found.append(got)
    assert all(f == found[0] for f in found)


def test_quantiles_take_a_fixed_number_of_jobs(spark):
    """Sketch, narrow, count: the same few scans for one column and for thirty."""
    df = spark.range(40_000).selectExpr(*[f"cast((id * {2 * i + 7919}) % 39983 as double) as c{i}" for i in range(30)])
    tracker = spark.sparkContext.statusTracker()
    for inside, most in ((10**9, 2), (2000, 4)):
        jobs = []
        for names in (["c0"], df.columns):
            spark.sparkContext.setJobGroup(f"quantiles-{inside}-{len(names)}", "")
            got = exact_quantiles(df, {c: F.col(c) for c in names}, (0.25, 0.5, 0.75), inside_rows=inside)
            scans = {s for j in tracker.getJobIdsForGroup(f"quantiles-{inside}-{len(names)}") for s in tracker.getJobInfo(j).stageIds}
            jobs.append(len(scans))
            want = {c: list(np.quantile(df.select(c).toPandas()[c], (0.25, 0.5, 0.75))) for c in names[:3]}
            assert {c: got[c] for c in names[:3]} == want
        spark.sparkContext.setJobGroup("", "")
        assert jobs[1] <= jobs[0] + 2


def test_quantiles_of_an_empty_column(spark):
    df = spark.range(50).selectExpr("cast(null as double) as x", "cast(id as double) as y")
    for inside in (5, 10**9):
        assert exact_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, (0.5,), inside) == {"x": [None], "y": [24.5]}
    assert exact_quantiles(df.limit(0), {"y": F.col("y")}, (0.5,)) == {"y": [None]} and exact_quantiles(df, {}, (0.5,)) == {}


def test_sketched_quantiles_lie_near_the_ranks(spark):
    df = spark.range(20_000).selectExpr("cast(id as double) as x", "cast(null as double) as y")
    got = sketch_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, (0.25, 0.5, 0.75))
    assert got["x"] == pytest.approx([5000, 10000, 15000], abs=100) and got["y"] == [None] * 3


@pytest.mark.parametrize("target", [None, "t"])
def test_folds_are_exact_disjoint_and_complete(spark, target):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'a' when id % 301 = 1 then 'rare' when id % 7 = 2 then null else 'b' end as t")
    folds = three_way_split(df, "id", target)
    ids = [{r["id"] for r in f.collect()} for f in folds]
    assert sum(map(len, ids)) == 3000 and len(set.union(*ids)) == 3000
    marked = assign_folds(df.repartition(3), "id", target)
    assert {r["id"] for r in marked.where("fold = 'val'").collect()} == ids[1]
    by = marked.groupBy("t", "fold").count() if target else marked.withColumn("t", F.lit("all")).groupBy("t", "fold").count()
    frame = by.toPandas().fillna({"t": "(null)"}).pivot(index="t", columns="fold", values="count").fillna(0)
    for _, r in frame.iterrows():
        n = r.sum()
        assert r["train"] == int(0.8 * n) and r["train"] + r["val"] == int(0.9 * n)


def test_profile_does_not_depend_on_partitions(spark, small):
    from siltworks.catalog.views import AS_OF, view
    from siltworks.operators.profiling import ProfileOptions, profile

    df = view(spark, small, "orders_dirty")
    a = profile(df, ProfileOptions(as_of=AS_OF)).orderBy("position").drop("mean", "skewness", "kurtosis", "std").collect()
    b = profile(df.repartition(13), ProfileOptions(as_of=AS_OF)).orderBy("position").drop("mean", "skewness", "kurtosis", "std").collect()
    assert a == b


def test_profile_quartiles_do_not_depend_on_the_number_of_scans(spark, small, monkeypatch):
    from siltworks.catalog.views import AS_OF, view
    from siltworks.operators import profiling as pr

    df = view(spark, small, "orders_dirty")
    columns = ["column", "q1", "median", "q3", "metrics"]
    want = pr.profile(df, pr.ProfileOptions(as_of=AS_OF, extended=True)).select(columns).collect()
    for inside in (10, 10**9):
        monkeypatch.setattr(pr, "exact_quantiles", lambda frame, values, p=(0.25, 0.5, 0.75), n=inside: exact_quantiles(frame, values, p, n))
        got = pr.profile(df, pr.ProfileOptions(as_of=AS_OF, extended=True)).select(columns).collect()
        assert {r["column"]: r for r in got} == {r["column"]: r for r in want}
