"""Recipes on streams: cleaning and feature steps carry no fitted state, so the batch chain runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siltworks.plans.feature_rounds import FeatureStep
from siltworks.plans.recipe import RecipeError, Step, replay
from siltworks.session import scratch_path


def stream_parquet(spark: SparkSession, path: str, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet folder (or the files of it that match a pattern) as a stream, with the schema of what lies there."""
    source = path if pattern is None else f"{path}/{pattern}"
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def replay_on_stream(steps: list[Step], features: list[FeatureStep], stream: DataFrame, target: str | None = None, fitted: dict[str, DataFrame] | None = None) -> DataFrame:
    """Cleaning then features on a stream.

    Duplicate removal needs the whole table and is refused. Frequencies must come from training: a static table,
    joined to each micro-batch.
    """
    if any(s.action == "drop_duplicates" for s in steps):
        raise RecipeError("duplicate removal needs the whole table; use deduplicated_tail on a stream")
    out = replay(steps, stream, target)
    for f in features:
        if f.fitted:
            counts = (fitted or {}).get(f.sources[0])
            if counts is None:
                raise RecipeError(f"{f.new_column} needs counts from training on a stream")
            out = out.join(counts.toDF(f.sources[0], f.new_column), f.sources[0], "left")
        else:
            out = f.apply(out)
    return out


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str | None = None, mode: str = "append") -> StreamingQuery:
    """Process what is available into a parquet folder, exactly once per checkpoint, and stop."""
    location = checkpoint or scratch_path(stream.sparkSession, "stream-checkpoint")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", location).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query
