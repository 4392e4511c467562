"""Run-log analytics (family L) over the events table in the role of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.catalog.registry import Family
from siltworks.catalog.views import ctes, table, view
from siltworks.functions.strings import truncate_with_length
from siltworks.operators import runlog as rl

family = Family()
QUERIES, ORACLES = family.queries, family.oracles
query = family.query

LOG = ctes("run_log")
LINES = ctes("log_lines")


def happened(kind: str) -> Column:
    return F.col("event_type") == kind


_ROUTE = r"^ROUTE\s+(\S+)\s*[→>]+\s*(\S+)\s*(?:\((.*)\))?$"
_NODE = r"^NODE\s+(\S+)\s*\|\s*(.+?)(?:\s*\|\s*(.*))?$"


def classified(spark, sf) -> DataFrame:
    return rl.classify_lines(view(spark, sf, "log_lines"), "line", "level")


@query(
    rf"""{LINES} select event_id, level, case when line like 'ROUTE%' then 'route_decision' when line like 'TOOL_CALL%' then 'tool_call' when line like 'PROFILE_SUMMARY%' then 'profile_summary' else 'log' end as type,
 nullif(regexp_extract(line, '{_ROUTE}', 1), '') as router, nullif(regexp_extract(line, '{_ROUTE}', 2), '') as decision, nullif(regexp_extract(line, '^TOOL_CALL\s+(\S+)', 1), '') as tool,
 nullif(regexp_extract(line, '{_NODE}', 1), '') as node, case when line like 'NODE%' then regexp_extract(line, '{_NODE}', 2) when line like 'something%' then line end as message,
 case when line like 'PROFILE_SUMMARY%' then line end as raw from log_lines"""
)
def classify_lines(spark, sf) -> DataFrame:
    return classified(spark, sf).select("event_id", "level", "type", "router", "decision", "tool", "node", "message", "raw")


@query("select doc_id, 'log' as type, text as message from documents")
def classify_free_text(spark, sf) -> DataFrame:
    """Text that fits no pattern, over several lines, stays a log event whole."""
    return rl.classify_lines(table(spark, sf, "documents"), "text").select("doc_id", "type", "message")


@query(
    rf"""{LINES}, c as (select event_id, coalesce(nullif(regexp_extract(line, '{_ROUTE}', 3), ''), nullif(regexp_extract(line, '{_NODE}', 3), '')) as ctx from log_lines),
 t as (select event_id, unnest(regexp_split_to_array(trim(ctx), '[,\s]+')) as t, generate_subscripts(regexp_split_to_array(trim(ctx), '[,\s]+'), 1) as i from c where ctx is not null),
 p as (select event_id, i, split_part(t, '=', 1) as key, regexp_replace(t, '^[^=]*=', '') as value from t where contains(t, '='))
 select event_id, key, arg_max(value, i) as value from p group by event_id, key"""
)
def context_pairs(spark, sf) -> DataFrame:
    """``k=v`` contexts; of equal keys the last one stays, tokens without ``=`` do not count."""
    df = classified(spark, sf).where("context is not null")
    return df.select("event_id", F.explode(rl.context_map(F.col("context"))).alias("key", "value"))


@query(rf"{LINES} select event_id, regexp_extract(line, 'params: ([^\n]*)', 1) as params, true as params_is_json, regexp_extract(line, 'result: ([^\n]*)', 1) as result_preview, false as result_is_json from log_lines where line like 'TOOL_CALL%'")
def labelled_fields(spark, sf) -> DataFrame:
    df = classified(spark, sf).where("type = 'tool_call'")
    return df.select("event_id", "params", rl.is_json(F.col("params")).alias("params_is_json"), "result_preview", rl.is_json(F.col("result_preview")).alias("result_is_json"))


@query("select event_id, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as seq from events")
def session_sequence(spark, sf) -> DataFrame:
    position = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    return rl.with_sequence(table(spark, sf, "events"), "user_id", ["ts", "event_id"], position).select("event_id", "seq")


_BUFFER = "b as (select * from (select *, row_number() over (partition by session order by seq desc) as rn from run_log) where rn <= 20)"


@query(f"{LOG}, {_BUFFER}, o as (select session, min(seq) as oldest from b group by 1) select session, seq, event_type, oldest - 1 > 8000 as truncated from b join o using (session) where seq > 8000")
def replay_since(spark, sf) -> DataFrame:
    """What a reader at 8000 still needs from the last 20 events per session, and whether some are lost already."""
    buffer = rl.last_n(view(spark, sf, "run_log"), "session", "seq", 20)
    return rl.replay_since(buffer.select("session", "seq", "event_type"), "session", "seq", 8000)


@query(f"{LOG} select session, seq, event_type from (select *, row_number() over (partition by session order by seq desc) as rn from run_log) where rn <= 10")
def ring_buffer(spark, sf) -> DataFrame:
    return rl.last_n(view(spark, sf, "run_log").select("session", "seq", "event_type"), "session", "seq", 10)


@query(
    rf"""{LINES}, k as (select *, case when line like 'ROUTE%' then 'route_decision' when line like 'TOOL_CALL%' then 'tool_call' when line like 'PROFILE_SUMMARY%' then 'profile_summary' else 'log' end as type from log_lines)
 select event_id, user_id, type, case when type = 'profile_summary' then substr(line, 1, 1500) end as raw, case when type = 'tool_call' then substr(regexp_extract(line, 'result: ([^\n]*)', 1), 1, 300) end as result_preview
 from (select *, row_number() over (partition by user_id order by event_id desc) as rn from k) where rn <= 25"""
)
def activity_view(spark, sf) -> DataFrame:
    return rl.activity_view(classified(spark, sf), "user_id", "event_id", 25).select("event_id", "user_id", "type", "raw", "result_preview")


_SPANS = f"""{LOG}, a as (select *, count(*) filter (where event_type = 'view') over (partition by session order by seq rows between unbounded preceding and 1 preceding) as starts from run_log where event_type in ('view', 'purchase')),
 p as (select *, max(case when event_type = 'view' then seq end) over w as open_seq, max(case when event_type = 'purchase' then seq end) over w as closed_seq from a
 window w as (partition by session, node order by seq rows between unbounded preceding and 1 preceding)),
 s as (select p.session, p.node, p.seq, p.ts as ended, case when p.closed_seq is null or p.open_seq > p.closed_seq then o.ts end as started, p.starts - o.starts - 1 as inner_starts
 from p left join a o on o.session = p.session and o.seq = p.open_seq where p.event_type = 'purchase')"""
_MS = "cast(floor((epoch_us(ended) - epoch_us(started)) / 1000.0) as bigint)"


@query(f"{_SPANS} select session, node, seq, {_MS} as duration_ms from s")
def node_durations(spark, sf) -> DataFrame:
    df = view(spark, sf, "run_log")
    return rl.node_spans(df, "session", "node", "seq", "ts", happened("view"), happened("purchase")).select("session", "node", "seq", "duration_ms")


@query(
    f"{_SPANS}, o as (select session, min(ts) as origin from run_log group by 1) select session, node, seq, cast(floor((epoch_us(started) - epoch_us(origin)) / 1000.0) as bigint) as offset_ms, {_MS} as duration_ms, inner_starts as children from s join o using (session) where started is not null"
)
def span_timeline(spark, sf) -> DataFrame:
    return rl.span_timeline(view(spark, sf, "run_log"), "session", "node", "seq", "ts", happened("view"), happened("purchase"))


_EDGES = f"{LOG}, e as (select node as source, target, count(*) as n from (select node, lead(node) over (partition by session order by seq) as target from run_log) where target is not null group by all)"


@query(f"{_EDGES} select source, target, n, round(n * 1.0::double / sum(n) over (partition by source), 9) as fraction from e")
def routing_edges(spark, sf) -> DataFrame:
    return rl.routing_edges(view(spark, sf, "run_log"), "session", "seq", "node").withColumn("fraction", F.round("fraction", 9))


@query(f"{_EDGES} select cast(sum(n) as bigint) as total_decisions, count(distinct source) as unique_sources, count(distinct target) as unique_targets from e")
def routing_summary(spark, sf) -> DataFrame:
    return rl.routing_summary(rl.routing_edges(view(spark, sf, "run_log"), "session", "seq", "node"))


@query("select user_id, event_type, count(*) as n from events group by all")
def event_counts(spark, sf) -> DataFrame:
    return rl.event_counts(table(spark, sf, "events"), "user_id", "event_type")


@query("select user_id, count(*) as events, cast(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0) as bigint) as duration_ms from events group by 1")
def session_durations(spark, sf) -> DataFrame:
    return rl.session_duration(table(spark, sf, "events"), "user_id", "ts")


@query(f"{LOG} select session, cast(row_number() over (partition by session order by seq) as bigint) as step, node from run_log")
def node_sequence(spark, sf) -> DataFrame:
    return rl.node_sequence(view(spark, sf, "run_log"), "session", "seq", "node")


@query(
    f"""{LOG}, p as (select session, seq as a, ts as entered, lead(ts) over (partition by session order by seq) as next_ts, lead(seq) over (partition by session order by seq) as b from run_log where event_type = 'signup')
 select p.session, cast(row_number() over (partition by p.session order by a) as bigint) as pass, strftime(entered, '%Y-%m-%dT%H:%M:%S') as entered,
 strftime(coalesce(max(ts) filter (where event_type = 'purchase' and node = 'node00'), max(ts) filter (where event_type = 'click'), any_value(next_ts), max(ts)), '%Y-%m-%dT%H:%M:%S') as exited
 from p join run_log r on r.session = p.session and r.seq >= a and (b is null or r.seq < b) group by p.session, a, entered"""
)
def pass_brackets(spark, sf) -> DataFrame:
    """A pass per signup; left at the last purchase of one node, else at the last click, else at its end."""
    main = happened("purchase") & (F.col("node") == "node00")
    out = rl.pass_brackets(view(spark, sf, "run_log"), "session", "seq", "ts", happened("signup"), main, happened("click"))
    return out.select("session", "pass", *[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) for c in ("entered", "exited")])


_DAILY = "d as (select event_type as metric, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as integer) as step, sum(value) as value from events group by all)"


def daily(spark, sf) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), day.alias("step")).agg(F.sum("value").alias("value"))


@query(f"with {_DAILY} select metric, step, round(value, 4) as value, round(value - lag(value) over (partition by metric order by step), 4) as delta from d")
def metric_deltas(spark, sf) -> DataFrame:
    out = rl.metric_deltas(daily(spark, sf), "metric", "step", "value")
    return out.select("metric", "step", F.round("value", 4).alias("value"), F.round("delta", 4).alias("delta"))


@query(
    f"""with {_DAILY}, e as (select *, value - lag(value) over (partition by metric order by step) as delta from d)
 select metric, count(*) as passes, round(arg_max(value, step), 4) as final_value, case when count(*) < 3 then 'undecided' when count(*) filter (where delta > 0) = 0 then 'converging' else 'not converging' end as status from e group by metric"""
)
def convergence(spark, sf) -> DataFrame:
    return rl.convergence(daily(spark, sf), "metric", "step", "value").withColumn("final_value", F.round("final_value", 4))


_RETRIES = f"""{LOG}, g as (select *, event_type = 'error' as failed, coalesce(sum(case when event_type <> 'error' then 1 else 0 end) over (partition by session, node order by seq rows between unbounded preceding and 1 preceding), 0) as island from run_log),
 r as (select session, node, min(seq) as first_seq, count(*) as attempts, bool_or(not failed) as succeeded, cast(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0) as bigint) as duration_ms from g group by session, node, island having bool_or(failed))"""


@query(f"{_RETRIES} select * from r")
def retry_sequences(spark, sf) -> DataFrame:
    return rl.retry_sequences(view(spark, sf, "run_log"), "session", "node", "seq", "ts", happened("error"))


@query(f"{_RETRIES} select count(*) as sequences, cast(sum(attempts) as bigint) as attempts, round(avg(case when succeeded then 1.0::double else 0 end), 9) as success_rate from r")
def retry_rate(spark, sf) -> DataFrame:
    out = rl.retry_rate(rl.retry_sequences(view(spark, sf, "run_log"), "session", "node", "seq", "ts", happened("error")))
    return out.withColumn("success_rate", F.round("success_rate", 9))


@query(
    f"""{LOG}, e as (select 'type' || (seq % 7) as error, node, 'message ' || (seq % 40) as message from run_log where event_type = 'error'),
 m as (select error, string_agg(message, ' | ' order by message) as samples from (select error, message, row_number() over (partition by error order by message) as rn from (select distinct error, message from e)) where rn <= 3 group by 1)
 select e.error, count(*) as errors, string_agg(distinct node, ',' order by node) as nodes, any_value(samples) as samples from e join m using (error) group by 1"""
)
def error_clusters(spark, sf) -> DataFrame:
    df = view(spark, sf, "run_log").where("event_type = 'error'").selectExpr("concat('type', cast(seq % 7 as string)) as error", "node", "concat('message ', cast(seq % 40 as string)) as message")
    return rl.error_clusters(df, "error", "node", "message")


@query(
    f"""{LOG} select node, model, count(*) as calls, cast(sum(seq % 100) as bigint) as tokens, round(sum(value), 2) as cost, round(avg(value), 6) as mean_duration, cast(case grouping(node, model) when 3 then 0 when 1 then 1 else 2 end as integer) as level
 from run_log group by rollup (node, model)"""
)
def cost_rollup(spark, sf) -> DataFrame:
    df = view(spark, sf, "run_log").withColumn("tokens", F.col("seq") % 100)
    out = rl.cost_rollup(df, "node", "model", "value", "tokens", "value")
    return out.withColumns({"cost": F.round("cost", 2), "mean_duration": F.round("mean_duration", 6)})


@query(f"{LOG} select (select node from run_log group by 1 order by sum(value) desc limit 1) as node, (select model from run_log group by 1 order by sum(value) desc limit 1) as model")
def most_expensive(spark, sf) -> DataFrame:
    return rl.most_expensive(view(spark, sf, "run_log"), "node", "model", "value")


STATES = {"signup": "running", "error": "failed", "purchase": "complete"}


@query(
    """select user_id, coalesce(arg_max(case event_type when 'signup' then 'running' when 'error' then 'failed' when 'purchase' then 'complete' end, event_id) filter (where event_type in ('signup', 'error', 'purchase')), 'pending') as status
 from events group by 1"""
)
def session_status(spark, sf) -> DataFrame:
    return rl.session_status(table(spark, sf, "events"), "user_id", "event_id", "event_type", STATES)


@query("select conv_id, cast(0 as bigint) as part, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) order by turn) as transcript from conversations group by 1")
def transcripts(spark, sf) -> DataFrame:
    return rl.transcript(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query(
    """with t as (select conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) order by turn) as whole from conversations group by 1)
 select conv_id, k as piece, k * 100 as start, substr(whole, k * 100 + 1, 100) as text from (select conv_id, whole, unnest(range((length(whole) + 99) // 100)) as k from t)"""
)
def transcript_pieces(spark, sf) -> DataFrame:
    """Transcripts in pieces of a hundred characters, cut inside lines where a piece ends there."""
    return rl.transcript_pieces(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", piece_chars=100)


@query(
    """select cast(month(o_orderdate) as integer) as pass_number, 'pass ' || month(o_orderdate) || ': findings ' || count(*) filter (where o_orderstatus = 'F') || ', steps ' || count(distinct o_orderpriority) || ', rows left ' || count(*) as line
 from orders group by 1, month(o_orderdate)"""
)
def history_lines(spark, sf) -> DataFrame:
    history = table(spark, sf, "orders").groupBy(F.month("o_orderdate").alias("pass_number")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("violations_found"), F.count_distinct("o_orderpriority").alias("steps_executed"), F.count(F.lit(1)).alias("rows_after")
    )
    return rl.history_lines(history)


@query("select doc_id, case when length(text) > 500 then substr(text, 1, 500) || '... [truncated, ' || length(text) || ' chars total]' else text end as preview from documents")
def truncated_texts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", truncate_with_length(F.col("text"), 500).alias("preview"))
