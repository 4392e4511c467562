"""Run-log analytics: typed events from raw lines, sequences, replay, pairing, routing, retries, costs.

Tables carry a session key and an ordering ``seq`` that is unique within the session. Windows run through the helpers
that cut hot sessions into slices, so one session may hold a third of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.operators.skew import HOT_ROWS, neighbour, row_numbers, running_before, skew_safe_lookup

# Line patterns and prefixes of the log format, and the event types they become.
ROUTE_RE = r"^ROUTE\s+(\S+)\s*[→>]+\s*(\S+)\s*(?:\((.*)\))?$"
NODE_RE = r"^NODE\s+(\S+)\s*\|\s*(.+?)(?:\s*\|\s*(.*))?$"
TOOL_RE = r"^TOOL_CALL\s+(\S+)"
PAYLOADS = ("INVESTIGATION_FINDINGS", "CLEANING_RECIPE", "PROFILE_SUMMARY", "MODEL_METADATA")
PREVIEW = 500
# Event types of the activity view, its cuts and its length; length of the replay buffer.
ACTIVITY_TYPES = (
    "route_decision",
    "tool_call",
    "investigation_findings",
    "cleaning_recipe",
    "profile_summary",
    "model_metadata",
    "log",
    "node_started",
    "node_completed",
    "target_selection_resolved",
)
ACTIVITY_PREVIEW, ACTIVITY_RAW, ACTIVITY_ROWS, BUFFER_ROWS = 300, 1500, 300, 1000
MIN_PASSES = 3
# Ways in which the last rows of a session are gathered side by side; characters of a transcript piece.
SALTS, PIECE_CHARS = 64, 65_536
# A transcript longer than this goes on in a further part.
PART_CHARS = 50_000_000


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def labelled_field(c: Column, label: str) -> Column:
    """Text behind a label on the first line that starts with it; null when no line does."""
    pattern = rf"(?m)^[ \t]*{label}[ \t]*(.*?)[ \t]*$"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def classify_lines(df: DataFrame, line: str, level: str | None = None) -> DataFrame:
    """Adds ``type`` and the fields of the type to raw log lines; what fits no pattern is a ``log`` event."""
    c = F.col(line)
    route, tool, node = c.rlike(ROUTE_RE), c.rlike(TOOL_RE), c.rlike(NODE_RE)
    kind = F.when(route, "route_decision").when(tool, "tool_call").when(node, "log")
    payload = F.lit(False)
    for prefix in PAYLOADS:
        kind = kind.when(c.startswith(prefix), prefix.lower())
        payload = payload | c.startswith(prefix)
    kind = kind.otherwise("log")
    is_node = ~route & ~tool & node
    plain = ~route & ~tool & ~node & ~payload
    return df.withColumns(
        {
            "type": kind,
            "router": F.when(route, _group(c, ROUTE_RE, 1)),
            "decision": F.when(route, _group(c, ROUTE_RE, 2)),
            "tool": F.when(~route & tool, _group(c, TOOL_RE, 1)),
            "params": F.when(~route & tool, labelled_field(c, "params:")),
            "result_preview": F.when(~route & tool, F.substring(F.coalesce(labelled_field(c, "result:"), F.lit("")), 1, PREVIEW)),
            "node": F.when(is_node, _group(c, NODE_RE, 1)),
            "message": F.when(is_node, _group(c, NODE_RE, 2)).when(plain, c),
            "context": F.when(route, _group(c, ROUTE_RE, 3)).when(is_node, _group(c, NODE_RE, 3)),
            "raw": F.when(~route & ~tool & ~node & payload, c),
            "level": F.col(level) if level else F.lit("DEBUG"),
        }
    )


def context_entries(c: Column) -> Column:
    """``k=v, k=v`` as an array of entries; tokens without ``=`` are left out, of equal keys the last one stays."""
    tokens = F.filter(F.split(F.trim(c), r"[,\s]+"), lambda t: t.contains("="))
    entries = F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.regexp_replace(t, r"^[^=]*=", "").alias("value")))
    size = F.size(entries)
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(size - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))


def context_map(c: Column) -> Column:
    return F.map_from_entries(context_entries(c))


def is_json(c: Column) -> Column:
    """True where the text parses as a JSON value."""
    return F.try_parse_json(c).isNotNull()


def with_sequence(df: DataFrame, session: str, order: list[str], position: Column, out: str = "seq", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds a 1-based sequence per session."""
    return row_numbers(df, [session], order, out, position, hot_rows)


def last_n(df: DataFrame, session: str, seq: str, n: int = BUFFER_ROWS, salts: int = SALTS) -> DataFrame:
    """The last ``n`` events per session, in two levels: per session and salt, then per session.

    A task sends at most ``n`` rows of a session, all under the salt of that task, so the rows that many tasks send for one hot
    session meet in ``salts`` tasks first; the last step sees ``n`` rows per salt, whatever the number of tasks.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    first = W.partitionBy(session, "_salt").orderBy(F.desc(seq))
    few = salted.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n).drop("_salt", "_rn")
    last = W.partitionBy(session).orderBy(F.desc(seq))
    return few.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= n).drop("_rn")


def replay_since(df: DataFrame, session: str, seq: str, since: int) -> DataFrame:
    """Events after ``since`` per session, with ``truncated`` where the buffer starts too late to continue seamlessly."""
    oldest = df.groupBy(session).agg(F.min(seq).alias("_oldest"), F.count(F.lit(1)).alias("_n"))
    later = df.where(F.col(seq) > since)
    joined = skew_safe_lookup(later, oldest, session, "_n", "_oldest")
    return joined.withColumn("truncated", F.col("_oldest") - 1 > since).select(*df.columns, "truncated")


def activity_view(df: DataFrame, session: str, seq: str, rows: int = ACTIVITY_ROWS) -> DataFrame:
    """Typed events fit for a summary: allowed types, long fields cut, the last ``rows`` per session."""
    allowed = df.where(F.col("type").isin(*ACTIVITY_TYPES))
    cut = {}
    if "result_preview" in df.columns:
        cut["result_preview"] = F.substring("result_preview", 1, ACTIVITY_PREVIEW)
    if "raw" in df.columns:
        cut["raw"] = F.substring("raw", 1, ACTIVITY_RAW)
    return last_n(allowed.withColumns(cut) if cut else allowed, session, seq, rows)


def node_spans(df: DataFrame, session: str, node: str, seq: str, ts: str, start: Column, end: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per end event: the latest start of its node that no earlier end used up, and the duration in ms.

    An end without such a start keeps a null duration. ``children`` counts the starts between start and end.
    """
    position = F.col(seq).cast("double")
    flagged = df.select(session, node, seq, ts, start.alias("_s"), end.alias("_e")).where("_s or _e")
    counted = running_before(flagged, [session], [seq], position, {"_starts": ("sum", F.col("_s").cast("long"))}, hot_rows)
    here = F.struct(F.col(seq).alias("seq"), F.col(ts).alias("ts"), F.coalesce("_starts", F.lit(0)).alias("starts"))
    paired = running_before(
        counted, [session, node], [seq], position, {"_open": ("max", F.when(F.col("_s"), here)), "_closed": ("max", F.when(F.col("_e"), F.col(seq)))}, hot_rows
    )
    matched = F.col("_open").isNotNull() & (F.col("_closed").isNull() | (F.col("_open.seq") > F.col("_closed")))
    millis = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_open.ts").cast("timestamp"))) / 1000
    return paired.where("_e").select(
        session,
        node,
        F.col(seq),
        F.when(matched, F.col("_open.ts")).alias("started"),
        F.col(ts).alias("ended"),
        F.when(matched, F.floor(millis)).alias("duration_ms"),
        F.when(matched, F.coalesce("_starts", F.lit(0)) - F.col("_open.starts") - 1).alias("children"),
    )


def span_timeline(df: DataFrame, session: str, node: str, seq: str, ts: str, start: Column, end: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Matched spans with their offset from the session's first event, duration and child count."""
    spans = node_spans(df, session, node, seq, ts, start, end, hot_rows).where("duration_ms is not null")
    origin = df.groupBy(session).agg(F.min(ts).alias("_origin"), F.count(F.lit(1)).alias("_n"))
    joined = skew_safe_lookup(spans, origin, session, "_n", "_origin")
    offset = (F.unix_micros(F.col("started").cast("timestamp")) - F.unix_micros(F.col("_origin").cast("timestamp"))) / 1000
    return joined.select(session, node, seq, F.floor(offset).alias("offset_ms"), "duration_ms", "children")


def routing_edges(df: DataFrame, session: str, seq: str, node: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(source, target, n, fraction)``: steps from one node to the next within a session, as a share of the source's steps."""
    steps = neighbour(df.select(session, seq, node), [session], [seq], F.col(seq).cast("double"), F.col(node), "_target", True, hot_rows)
    edges = steps.where("_target is not null").groupBy(F.col(node).alias("source"), F.col("_target").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return edges.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy("source")))


def routing_summary(edges: DataFrame) -> DataFrame:
    return edges.agg(
        F.sum("n").alias("total_decisions"), F.count_distinct("source").alias("unique_sources"), F.count_distinct("target").alias("unique_targets")
    )


def event_counts(df: DataFrame, session: str, kind: str) -> DataFrame:
    return df.groupBy(session, kind).agg(F.count(F.lit(1)).alias("n"))


def session_duration(df: DataFrame, session: str, ts: str) -> DataFrame:
    """Events and wall-clock milliseconds per session."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.groupBy(session).agg(F.count(F.lit(1)).alias("events"), F.floor((F.max(micros) - F.min(micros)) / 1000).alias("duration_ms"))


def node_sequence(df: DataFrame, session: str, seq: str, node: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The order in which nodes ran, one row per step: a session's path may be too long for one value."""
    return row_numbers(df.select(session, seq, node), [session], [seq], "step", F.col(seq).cast("double"), hot_rows).select(session, "step", node)


def pass_brackets(df: DataFrame, session: str, seq: str, ts: str, enter: Column, main_exit: Column, other_exit: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(session, pass, entered, exited)``: a pass begins at each enter event and ends before the next one.

    It is left at the last main exit inside, else at the last other exit inside, else at its end. Every event belongs
    to the pass whose number is the count of enters so far, so no range join is needed.
    """
    position = F.col(seq).cast("double")
    marked = df.select(session, seq, ts, enter.alias("_in"), main_exit.alias("_a"), other_exit.alias("_b"))
    numbered = running_before(marked, [session], [seq], position, {"_before": ("sum", F.col("_in").cast("long"))}, hot_rows)
    numbered = numbered.withColumn("pass", F.coalesce("_before", F.lit(0)) + F.col("_in").cast("long")).where(F.col("pass") > 0)
    passes = numbered.groupBy(session, "pass").agg(
        F.min(ts).alias("entered"), F.max(F.when(F.col("_a"), F.col(ts))).alias("_xa"), F.max(F.when(F.col("_b"), F.col(ts))).alias("_xb"), F.max(ts).alias("_last")
    )
    ahead = neighbour(passes, [session], ["pass"], F.col("pass").cast("double"), F.col("entered"), "_end", True, hot_rows)
    return ahead.select(session, "pass", "entered", F.coalesce("_xa", "_xb", "_end", "_last").alias("exited"))


def metric_deltas(df: DataFrame, metric: str, step: str, value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each metric's change from the pass before."""
    before = neighbour(df.select(metric, step, value), [metric], [step], F.col(step).cast("double"), F.col(value), "_previous", False, hot_rows)
    return before.select(metric, step, value, (F.col(value) - F.col("_previous")).alias("delta"))


def convergence(df: DataFrame, metric: str, step: str, value: str, lower_is_better: bool = True) -> DataFrame:
    """Per metric: passes, final value, and whether every pass improved it; undecided below three passes."""
    deltas = metric_deltas(df, metric, step, value)
    worse = F.col("delta") > 0 if lower_is_better else F.col("delta") < 0
    folded = deltas.groupBy(metric).agg(F.count(F.lit(1)).alias("passes"), F.max_by(value, step).alias("final_value"), F.count_if(worse).alias("_worse"))
    status = F.when(F.col("passes") < MIN_PASSES, "undecided").when(F.col("_worse") == 0, "converging").otherwise("not converging")
    return folded.select(metric, "passes", "final_value", status.alias("status"))


def retry_sequences(df: DataFrame, session: str, node: str, seq: str, ts: str, failed: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per run of failures of a node with the attempt that ended it: attempts, success, duration."""
    marked = df.select(session, node, seq, ts, failed.alias("_f"))
    grouped = running_before(marked, [session, node], [seq], F.col(seq).cast("double"), {"_island": ("sum", (~F.col("_f")).cast("long"))}, hot_rows)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    runs = grouped.groupBy(session, node, F.coalesce("_island", F.lit(0)).alias("_island")).agg(
        F.min(seq).alias("first_seq"),
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("_f").alias("_failures"),
        F.bool_or(~F.col("_f")).alias("succeeded"),
        F.floor((F.max(micros) - F.min(micros)) / 1000).alias("duration_ms"),
    )
    return runs.where("_failures > 0").drop("_island", "_failures")


def retry_rate(sequences: DataFrame) -> DataFrame:
    return sequences.agg(F.count(F.lit(1)).alias("sequences"), F.sum("attempts").alias("attempts"), F.avg(F.col("succeeded").cast("double")).alias("success_rate"))


def error_clusters(df: DataFrame, error: str, node: str, message: str, samples: int = 3) -> DataFrame:
    """Errors by type: count, the nodes they hit, and the first sample messages in text order."""
    per_node = df.groupBy(error, node).agg(F.count(F.lit(1)).alias("n"))
    nodes = per_node.groupBy(error).agg(F.sum("n").alias("errors"), F.array_join(F.array_sort(F.collect_set(node)), ",").alias("nodes"))
    w = W.partitionBy(error).orderBy(message)
    few = df.groupBy(error, message).agg(F.count(F.lit(1)).alias("_c")).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= samples)
    texts = few.groupBy(error).agg(F.array_join(F.array_sort(F.collect_list(message)), " | ").alias("samples"))
    return nodes.join(texts, error)


def cost_rollup(df: DataFrame, node: str, model: str, cost: str, tokens: str, duration: str) -> DataFrame:
    """Calls, tokens, cost and mean duration: in total, per node, per node and model (``level`` 0, 1, 2)."""
    rolled = df.rollup(node, model).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens"), F.sum(cost).alias("cost"), F.avg(duration).alias("mean_duration"), F.grouping_id().alias("_g")
    )
    return rolled.withColumn("level", F.when(F.col("_g") == 3, 0).when(F.col("_g") == 1, 1).otherwise(2)).drop("_g")


def most_expensive(df: DataFrame, node: str, model: str, cost: str) -> DataFrame:
    """One row: the node and the model with the highest total cost."""
    by_node = df.groupBy(node).agg(F.sum(cost).alias("c")).agg(F.max_by(node, "c").alias("node"))
    by_model = df.groupBy(model).agg(F.sum(cost).alias("c")).agg(F.max_by(model, "c").alias("model"))
    return by_node.withColumn("model", by_model.scalar())


# Session states by the event that brings them about.
STATUS_BY_EVENT = {
    "session_started": "running",
    "target_selection_required": "paused",
    "target_selection_resolved": "running",
    "pipeline_complete": "complete",
    "pipeline_failed": "failed",
    "session_cancelled": "cancelled",
}
INITIAL_STATUS = "pending"


def session_status(df: DataFrame, session: str, seq: str, kind: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """The latest state of each session; one without a state event is pending."""
    status = F.lit(None).cast("string")
    for event, state in (mapping or STATUS_BY_EVENT).items():
        status = F.when(F.col(kind) == event, state).otherwise(status)
    folded = df.groupBy(session).agg(F.max_by(status, F.when(status.isNotNull(), F.col(seq))).alias("status"))
    return folded.withColumn("status", F.coalesce("status", F.lit(INITIAL_STATUS)))


def transcript(df: DataFrame, conversation: str, turn: str, role: str, text: str, part_chars: int = PART_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``ROLE: text`` in order, joined by blank lines.

    A conversation is one document, part 0, up to ``part_chars`` characters; a longer one goes on in numbered parts
    that follow each other, so that no value and no task has to hold a conversation of any length.
    """
    lines = df.select(conversation, F.col(turn).alias("_t"), F.concat(F.upper(role), F.lit(": "), F.col(text)).alias("_line"))
    placed = running_before(lines, [conversation], ["_t"], F.col("_t").cast("double"), {"_chars": ("sum", F.length("_line").cast("long"))}, hot_rows)
    part = F.floor(F.coalesce("_chars", F.lit(0)) / F.lit(part_chars))
    said = F.struct(F.col("_t").alias("t"), F.col("_line").alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda s: s["line"]), "\n\n")
    return placed.groupBy(conversation, part.alias("part")).agg(joined.alias("transcript"))


def transcript_pieces(df: DataFrame, conversation: str, turn: str, role: str, text: str, piece_chars: int = PIECE_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(conversation, piece, start, text)``: the transcript cut at every ``piece_chars`` characters, the last piece shorter.

    Prefix sums give every line its place; a line goes to the pieces its characters lie in, cut to each. A piece is
    gathered from its own characters alone, so a conversation of any length has one form, and joining its pieces gives the
    transcript. Lines without a text are left out; a conversation without any has no piece.
    """
    lines = df.select(conversation, F.col(turn).alias("_t"), F.concat(F.upper(role), F.lit(": "), F.col(text)).alias("_line")).where(F.col("_line").isNotNull())
    before = {"_chars": ("sum", F.length("_line").cast("long") + 2)}
    placed = running_before(lines, [conversation], ["_t"], F.col("_t").cast("double"), before, hot_rows)
    first = F.col("_chars").isNull()
    shown = placed.select(
        conversation, "_t", F.when(first, F.lit(0)).otherwise(F.col("_chars") - 2).alias("_at"), F.when(first, F.col("_line")).otherwise(F.concat(F.lit("\n\n"), F.col("_line"))).alias("_line")
    )
    size = F.lit(piece_chars)
    last = F.floor((F.col("_at") + F.length("_line") - 1) / size)
    spread = shown.select("*", F.explode(F.sequence(F.floor(F.col("_at") / size), last)).alias("piece"))
    begin = F.greatest(F.col("piece") * size - F.col("_at"), F.lit(0))
    end = F.least((F.col("piece") + 1) * size - F.col("_at"), F.length("_line").cast("long"))
    cut = F.substring(F.col("_line"), (begin + 1).cast("int"), (end - begin).cast("int"))
    part = F.struct(F.col("_at").alias("at"), cut.alias("cut"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["cut"]), "")
    return spread.groupBy(conversation, "piece").agg(joined.alias("text")).select(conversation, "piece", (F.col("piece") * size).alias("start"), "text")


def history_lines(history: DataFrame) -> DataFrame:
    """One readable line per pass."""
    return history.select(
        "pass_number",
        F.format_string("pass %d: findings %d, steps %d, rows left %d", "pass_number", "violations_found", "steps_executed", "rows_after").alias("line"),
    )
