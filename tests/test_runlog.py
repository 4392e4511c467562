"""Golden cases of the run log."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltworks.operators import runlog as rl

LINES = {
    "ROUTE route_check → evaluate (pass_count=0)": {"type": "route_decision", "router": "route_check", "decision": "evaluate", "context": "pass_count=0"},
    "ROUTE a > b": {"type": "route_decision", "router": "a", "decision": "b", "context": None},
    'TOOL_CALL look\n  params: {"column": "age"}\n  result: 3 rows': {"type": "tool_call", "tool": "look", "params": '{"column": "age"}', "result_preview": "3 rows"},
    "TOOL_CALL look": {"type": "tool_call", "tool": "look", "params": None, "result_preview": ""},
    "NODE profiler | profiling done | rows=5 cols=2": {"type": "log", "node": "profiler", "message": "profiling done", "context": "rows=5 cols=2"},
    "NODE profiler | started": {"type": "log", "node": "profiler", "message": "started", "context": None},
    "CLEANING_RECIPE steps=3\n  1 drop": {"type": "cleaning_recipe", "raw": "CLEANING_RECIPE steps=3\n  1 drop"},
    "PROFILE_SUMMARY rows=5": {"type": "profile_summary", "raw": "PROFILE_SUMMARY rows=5"},
    "INVESTIGATION_FINDINGS x": {"type": "investigation_findings"},
    "MODEL_METADATA x": {"type": "model_metadata"},
    "something odd": {"type": "log", "message": "something odd", "node": None},
}


def test_lines_become_typed_events(spark):
    df = spark.createDataFrame([(k,) for k in LINES], "line string")
    for row in rl.classify_lines(df, "line").collect():
        for field, value in LINES[row["line"]].items():
            assert row[field] == value, (row["line"], field)


def test_level_is_kept(spark):
    df = spark.createDataFrame([("careful", "WARNING")], "line string, level string")
    assert rl.classify_lines(df, "line", "level").first()["level"] == "WARNING"


def test_long_results_are_cut(spark):
    df = spark.createDataFrame([("TOOL_CALL t\n result: " + "x" * 900,)], "line string")
    assert len(rl.classify_lines(df, "line").first()["result_preview"]) == 500


@pytest.mark.parametrize(
    "text, want",
    [("a=1, b=2", {"a": "1", "b": "2"}), ("a=1 b=x=y loose", {"a": "1", "b": "x=y"}), ("a=1, a=2, c=, a=3", {"a": "3", "c": ""}), ("none at all", {})],
)
def test_context_maps(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(rl.context_map(F.col("c")).alias("m")).first()["m"] == want


def feed(spark, n):
    return spark.range(1, n + 1).selectExpr("'s' as session", "id as seq")


def test_ring_buffer_keeps_the_last(spark):
    kept = [r["seq"] for r in rl.last_n(feed(spark, 15), "session", "seq", 10).orderBy("seq").collect()]
    assert kept == list(range(6, 16))


def test_replay_since(spark):
    out = rl.replay_since(feed(spark, 5), "session", "seq", 2).orderBy("seq").collect()
    assert [(r["seq"], r["truncated"]) for r in out] == [(3, False), (4, False), (5, False)]


def test_replay_says_what_is_lost(spark):
    buffer = rl.last_n(feed(spark, 5), "session", "seq", 3)
    out = rl.replay_since(buffer, "session", "seq", 1).orderBy("seq").collect()
    assert [(r["seq"], r["truncated"]) for r in out] == [(3, True), (4, True), (5, True)]


def test_activity_view_trims_and_selects(spark):
    rows = [("s", i, "heartbeat" if i % 2 else "tool_call", "y" * 900) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "session string, seq long, type string, result_preview string")
    out = rl.activity_view(df, "session", "seq", 3).orderBy("seq").collect()
    assert [r["seq"] for r in out] == [6, 8, 10] and all(len(r["result_preview"]) == 300 for r in out)


def test_convergence_needs_three_passes(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 3.0), ("b", 1, 5.0), ("b", 2, 3.0), ("b", 3, 1.0), ("c", 1, 1.0), ("c", 2, 4.0), ("c", 3, 0.0)], "m string, p int, v double")
    got = {r["m"]: (r["status"], r["final_value"]) for r in rl.convergence(df, "m", "p", "v").collect()}
    assert got == {"a": ("undecided", 3.0), "b": ("converging", 1.0), "c": ("not converging", 0.0)}


def test_spans_count_their_children(spark):
    events = [(1, "outer", "s"), (2, "inner", "s"), (3, "inner", "e"), (4, "inner", "s"), (5, "inner", "e"), (6, "outer", "e"), (7, "outer", "e")]
    df = spark.createDataFrame([("x", n, i, k) for i, n, k in events], "session string, node string, seq long, kind string").withColumn("ts", F.timestamp_seconds("seq"))
    got = {r["seq"]: (r["duration_ms"], r["children"]) for r in rl.node_spans(df, "session", "node", "seq", "ts", F.col("kind") == "s", F.col("kind") == "e").collect()}
    assert got == {3: (1000, 0), 5: (1000, 0), 6: (5000, 2), 7: (None, None)}


def test_status_without_events_is_pending(spark):
    df = spark.createDataFrame([("a", 1, "log"), ("b", 1, "session_started"), ("b", 2, "pipeline_failed"), ("b", 3, "log")], "s string, q long, k string")
    assert {r["s"]: r["status"] for r in rl.session_status(df, "s", "q", "k").collect()} == {"a": "pending", "b": "failed"}


def test_brackets_prefer_the_main_exit(spark):
    kinds = ["enter", "other", "main", "other", "enter", "other", "noise", "enter", "noise"]
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate(kinds)], "session string, seq long, kind string").withColumn("ts", F.timestamp_seconds("seq"))
    k = F.col("kind")
    out = rl.pass_brackets(df, "session", "seq", "ts", k == "enter", k == "main", k == "other").orderBy("pass")
    got = [(r["pass"], r["a"], r["b"]) for r in out.select("pass", F.unix_seconds("entered").alias("a"), F.unix_seconds("exited").alias("b")).collect()]
    assert got == [(1, 0, 2), (2, 4, 5), (3, 7, 8)]


def test_long_conversations_go_on_in_parts(spark):
    df = spark.createDataFrame([("c", i, "user", "x" * 10) for i in range(30)] + [("d", 0, "user", "hi")], "conv string, turn long, role string, text string")
    whole = {r["conv"]: r["transcript"] for r in rl.transcript(df, "conv", "turn", "role", "text").collect()}
    for hot_rows in (5, 10**9):
        parts = rl.transcript(df, "conv", "turn", "role", "text", 100, hot_rows).orderBy("conv", "part").collect()
        assert "\n\n".join(r["transcript"] for r in parts if r["conv"] == "c") == whole["c"] and sum(r["conv"] == "c" for r in parts) == 5
        assert [r["transcript"] for r in parts if r["conv"] == "d"] == ["USER: hi"]
