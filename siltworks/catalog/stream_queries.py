"""Streaming forms (family M) and user functions (family N). Each stream runs over the given table until it is drained."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.catalog.profile_queries import CLEANING
from siltworks.catalog.registry import Family
from siltworks.catalog.runlog_queries import STATES, _MS, _SPANS
from siltworks.catalog.views import VIEWS, ctes, table
from siltworks.operators.features import value_counts
from siltworks.plans.feature_rounds import FeatureStep
from siltworks.plans.recipe import Step, replay
from siltworks.session import scratch_path
from siltworks.streaming.monitor import windowed_quality
from siltworks.streaming.replay import replay_on_stream, run_to_parquet, stream_parquet
from siltworks.streaming.sessions import live_durations, live_status, settled_durations
from siltworks.streaming.tail import deduplicated_tail

family = Family()
QUERIES, ORACLES = family.queries, family.oracles
query = family.query


def stream(spark, sf: str, name: str) -> DataFrame:
    return stream_parquet(spark, sf, f"{name}.parquet")


def drained(frame: DataFrame, name: str) -> DataFrame:
    """Run a stream to its end into a written table and read that."""
    path = scratch_path(frame.sparkSession, name)
    run_to_parquet(frame, path)
    return frame.sparkSession.read.parquet(path)


def drained_complete(frame: DataFrame, name: str) -> DataFrame:
    """The same for aggregates whose whole result is written anew with each micro-batch."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    location = scratch_path(spark, f"{name}-checkpoint")
    frame.writeStream.outputMode("complete").option("checkpointLocation", location).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(path)


def dirty_stream(spark, sf: str) -> DataFrame:
    return spark.sql(VIEWS["orders_dirty"].replace("from orders", "from {orders}"), orders=stream(spark, sf, "orders"))


_AMOUNT = "case when amount not in (-1, 9999) and isfinite(amount) then amount end"


@query(
    f"""{ctes('orders_dirty')}, c as (select priority, count(*) as n from orders_dirty where priority is not null group by 1)
 select o_orderkey, {_AMOUNT} as amount, status, round(ln(1 + {_AMOUNT}), 6) as amount_log, c.n as priority_count from orders_dirty left join c using (priority) where ({_AMOUNT}) is not null"""
)
def stream_recipe_replay(spark, sf) -> DataFrame:
    """The recipe and features of the batch job on a stream; frequencies come from a static table."""
    batch = spark.sql(VIEWS["orders_dirty"].replace("from orders", "from {orders}"), orders=table(spark, sf, "orders"))
    features = [FeatureStep("amount_log", "NUMERIC_TRANSFORM", ("amount",), {"kind": "log1p"}), FeatureStep("priority_count", "CATEGORY_ENCODE", ("priority",), {"kind": "frequency"})]
    out = replay_on_stream(CLEANING, features, dirty_stream(spark, sf), "amount", {"priority": value_counts(batch, "priority")})
    return drained(out.select("o_orderkey", "amount", "status", F.round("amount_log", 6).alias("amount_log"), "priority_count"), "replay")


@query(
    """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as rows, avg(case when value is not null then 1.0::double else 0 end) as completeness,
 round(avg(case when value in (-1, 0, 999, 9999) then 1.0::double else 0 end), 9) as sentinel_share, count(*) filter (where ts > timestamp '2024-01-15') as future_dates from events group by 1"""
)
def stream_quality(spark, sf) -> DataFrame:
    import datetime as dt

    out = windowed_quality(stream(spark, sf, "events"), "ts", "value", as_of=dt.date(2024, 1, 15))
    done = drained_complete(out, "quality")
    return done.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "rows", "completeness", F.round("sentinel_share", 9).alias("sentinel_share"), "future_dates")


@query("select user_id, event_id, event_type from events")
def stream_tail(spark, sf) -> DataFrame:
    """Every event delivered twice by the source arrives once."""
    events = stream(spark, sf, "events")
    twice = events.unionByName(stream(spark, sf, "events"))
    fresh = deduplicated_tail(twice, "user_id", "event_id", "ts")
    return drained(fresh.select("user_id", "event_id", "event_type"), "tail")


@query(f"{_SPANS} select cast(session as varchar) as session, node, seq, {_MS} as duration_ms from s")
def stream_durations(spark, sf) -> DataFrame:
    """With the default lateness of an hour; starts may be days older."""
    log = spark.sql(VIEWS["run_log"].replace("from events", "from {events}"), events=stream(spark, sf, "events"))
    return settled_durations(drained(live_durations(log, "session", "node", "seq", "ts", "event_type", "view", "purchase"), "durations"))


@query(
    """select user_id, coalesce(arg_max(case event_type when 'signup' then 'running' when 'error' then 'failed' when 'purchase' then 'complete' end, event_id) filter (where event_type in ('signup', 'error', 'purchase')), 'pending') as status
 from events group by 1"""
)
def stream_status(spark, sf) -> DataFrame:
    return drained_complete(live_status(stream(spark, sf, "events"), "user_id", "event_id", "event_type", STATES), "status")


@query("select o_orderkey, upper(o_orderstatus) || '-' || o_orderpriority as tag from orders where o_totalprice > 1000")
def user_table_function(spark, sf) -> DataFrame:
    """A trusted user's own step: any DataFrame to DataFrame function chains with the recipe steps."""

    def tag(df: DataFrame) -> DataFrame:
        return df.withColumn("tag", F.concat(F.upper("o_orderstatus"), F.lit("-"), F.col("o_orderpriority")))

    df = replay([Step(1, "DROP_ROWS", "drop_rows", None, {"condition": "o_totalprice <= 1000"})], table(spark, sf, "orders"))
    return df.transform(tag).select("o_orderkey", "tag")


@query("select o_orderkey, round(o_totalprice / (1 + o_custkey % 7), 4) as share from orders")
def user_column_function(spark, sf) -> DataFrame:
    """A custom feature as a vectorised function over columns."""

    @F.pandas_udf("double")
    def share(price: pd.Series, customer: pd.Series) -> pd.Series:
        return price / (1 + customer % 7)

    return table(spark, sf, "orders").select("o_orderkey", F.round(share("o_totalprice", "o_custkey"), 4).alias("share"))


@query("select o_orderpriority, round(sqrt(avg(o_totalprice * o_totalprice)), 2) as root_mean_square from orders group by 1")
def user_aggregate(spark, sf) -> DataFrame:
    """A custom aggregate composed of built-in ones, so that groups of any size fold in the tasks."""
    square = F.col("o_totalprice") * F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.sqrt(F.avg(square)), 2).alias("root_mean_square"))
