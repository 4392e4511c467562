"""Streams over several micro-batches give what the batch gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltworks.catalog.profile_queries import CLEANING
from siltworks.operators.runlog import node_spans
from siltworks.plans.feature_rounds import FeatureStep
from siltworks.plans.recipe import RecipeError, Step
from siltworks.streaming.replay import replay_on_stream, run_to_parquet, stream_parquet
from siltworks.streaming.sessions import live_durations, settled_durations
from siltworks.streaming.tail import deduplicated_tail


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """Events in four files, one micro-batch each, in order of time."""
    path = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{small}/events.parquet")
    for i in range(4):
        low, high = i * 250, (i + 1) * 250 if i < 3 else 10**9
        part = events.where(F.col("event_id").between(low, high - 1))
        part.coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def drained(spark, frame, tmp_path):
    run_to_parquet(frame, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return spark.read.parquet(str(tmp_path / "out"))


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def paired(batch):
    """The batch form, node by node."""
    start, end = F.col("event_type") == "view", F.col("event_type") == "purchase"
    return node_spans(batch.withColumn("node", F.lit("x")), "user_id", "node", "event_id", "ts", start, end).select(F.col("event_id"), "duration_ms")


@pytest.mark.parametrize("lateness", ["1 hour", "400 days"])
def test_durations_pair_across_batches(spark, folder, tmp_path, lateness):
    """Starts far older than the lateness are still there when their end arrives."""
    batch = spark.read.parquet(folder)
    stream = stream_parquet(spark, folder, files_per_trigger=1).withColumn("node", F.lit("x"))
    live = live_durations(stream, "user_id", "node", "event_id", "ts", "event_type", "view", "purchase", lateness)
    got = settled_durations(drained(spark, live, tmp_path))
    assert pairs(got.select("seq", "duration_ms")) == pairs(paired(batch))
    assert got.where("duration_ms > 3600 * 1000").count() > 0


@pytest.fixture(scope="module")
def jumbled(spark, tmp_path_factory):
    """A minute between events, each in a file up to twenty minutes early or late, six files in order of time."""
    path = str(tmp_path_factory.mktemp("jumbled"))
    rows = spark.range(900).selectExpr(
        "id as event_id", "id % 3 as user_id", "timestamp_seconds(1700000000 + id * 60) as ts",
        "case when pmod(xxhash64(id), 5) < 2 then 'view' when pmod(xxhash64(id), 5) < 4 then 'purchase' else 'other' end as event_type",
        "cast(greatest(0, least(5, (id + pmod(xxhash64(id, 7), 40) - 20) / 150)) as int) as file",
    )
    for i in range(6):
        rows.where(F.col("file") == i).drop("file").coalesce(1).write.mode("append").parquet(path)
    return path


def test_durations_of_events_that_come_out_of_order(spark, jumbled, tmp_path):
    batch = spark.read.parquet(jumbled)
    stream = stream_parquet(spark, jumbled, files_per_trigger=1).withColumn("node", F.lit("x"))
    told = drained(spark, live_durations(stream, "user_id", "node", "event_id", "ts", "event_type", "view", "purchase"), tmp_path)
    assert pairs(settled_durations(told).select("seq", "duration_ms")) == pairs(paired(batch))
    assert told.where("revision > 1").count() > 0


def test_open_starts_expire_where_that_is_asked(spark, tmp_path):
    path = str(tmp_path / "in")
    for i, (kind, hour) in enumerate([("view", 0), ("other", 5), ("other", 30), ("other", 60), ("purchase", 61)]):
        spark.sql(f"select {i}L as event_id, 1L as user_id, timestamp_seconds(1700000000 + {hour} * 3600) as ts, '{'view' if kind == 'other' else kind}' as event_type, '{'y' if kind == 'other' else 'x'}' as node").coalesce(1).write.mode("append").parquet(path)
    for hours, want in ((None, 61 * 3_600_000), (24.0, None)):
        out = tmp_path / f"out-{hours}"
        out.mkdir()
        live = live_durations(stream_parquet(spark, path, files_per_trigger=1), "user_id", "node", "event_id", "ts", "event_type", "view", "purchase", expiry_hours=hours)
        assert [r["duration_ms"] for r in settled_durations(drained(spark, live, out)).collect()] == [want]


def test_repeats_arrive_once(spark, folder, tmp_path):
    one = stream_parquet(spark, folder, files_per_trigger=1)
    out = drained(spark, deduplicated_tail(one.unionByName(stream_parquet(spark, folder, files_per_trigger=2)), "user_id", "event_id", "ts", "400 days"), tmp_path)
    assert out.count() == out.select("event_id").distinct().count() == spark.read.parquet(folder).count()


def test_what_a_stream_cannot_do(spark, folder):
    stream = stream_parquet(spark, folder)
    with pytest.raises(RecipeError):
        replay_on_stream([Step(1, "DROP_ROWS", "drop_duplicates", None, {"keys": ["event_id"]})], [], stream)
    with pytest.raises(RecipeError):
        replay_on_stream([], [FeatureStep("n", "CATEGORY_ENCODE", ("event_type",), {"kind": "frequency"})], stream)
    with pytest.raises(RecipeError):
        replay_on_stream(CLEANING, [], stream, "amount")
