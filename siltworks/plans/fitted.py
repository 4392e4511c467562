"""Everything a run learns from its training fold, kept as one value that is replayed on other folds, saved and loaded."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.profiling import ProfileOptions, profile
from siltworks.operators.violations import Rules, drop_candidates
from siltworks.plans.feature_rounds import FeatureStep, RoundsResult, fit, propose_features, replay_features, run_rounds
from siltworks.plans.passes import PassesResult, clean_in_passes
from siltworks.plans.recipe import Step, replay
from siltworks.session import cut_lineage, scratch_path

# Continuous measurements are nearly unique by nature; only texts and whole numbers are identifiers.
MEASURED = ("double", "float", "timestamp", "timestamp_ntz", "date")


@dataclass
class FitState:
    """Cleaning steps, dropped columns, feature steps and the counts behind frequency encodings."""

    target: str
    key: str
    steps: list[Step]
    dropped: list[str]
    features: list[FeatureStep]
    counts: dict[str, DataFrame] = field(default_factory=dict)

    def clean(self, df: DataFrame) -> DataFrame:
        """The cleaning steps on another fold; any error aborts."""
        out = replay(self.steps, df, self.target)
        missing = [c for c in self.dropped if c not in out.columns]
        if missing:
            raise ValueError(f"the fold lacks columns to drop: {missing}")
        return out.drop(*self.dropped)

    def derive(self, cleaned: DataFrame) -> DataFrame:
        """The feature steps on a cleaned fold, with the training fold's counts."""
        return replay_features(self.features, cleaned, self.counts)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.derive(self.clean(df))

    def save(self, spark: SparkSession, folder: str) -> None:
        """One JSON line of steps, one parquet table per encoding; through Spark, so any file system it knows will do."""

        def plain(x):
            return str(x) if isinstance(x, (dt.date, dt.datetime)) else list(x)

        state = {
            "target": self.target,
            "key": self.key,
            "steps": [asdict(s) for s in self.steps],
            "dropped": self.dropped,
            "features": [asdict(f) for f in self.features],
            "counts": list(self.counts),
        }
        spark.createDataFrame([(json.dumps(state, default=plain),)], "state string").coalesce(1).write.mode("overwrite").text(f"{folder}/state")
        for i, frame in enumerate(self.counts.values()):
            frame.write.mode("overwrite").parquet(f"{folder}/counts-{i}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> FitState:
        state = json.loads(spark.read.text(f"{folder}/state").first()[0])
        features = [FeatureStep(**(f | {"sources": tuple(f["sources"])})) for f in state["features"]]
        counts = {c: spark.read.parquet(f"{folder}/counts-{i}") for i, c in enumerate(state["counts"])}
        return FitState(state["target"], state["key"], [Step(**s) for s in state["steps"]], state["dropped"], features, counts)


@dataclass
class Fitted:
    """A fit state beside what was seen while it was learnt."""

    state: FitState
    passes: PassesResult
    rounds: RoundsResult
    table: DataFrame


def fit_state(
    train: DataFrame,
    target: str,
    key: str,
    rules: Rules | None = None,
    declared: list[Step] | None = None,
    features: list[FeatureStep] | None = None,
    drop_identifiers: bool = True,
) -> Fitted:
    """Learn cleaning, dropped columns and features from the training fold alone.

    ``declared`` steps come first, then what the passes find still wrong; ``features`` replace the proposed ones. The cleaned
    fold is materialised by the passes; counts are written once, so that every fold reads the same.
    """
    rules = replace(rules or Rules(), target=target)
    declared = list(declared or [])
    started = replay(declared, train, target) if declared else train
    started = cut_lineage(started) if declared else started
    passes = clean_in_passes(started, rules)
    # A row per column, read for what to drop and for the features.
    after = cut_lineage(profile(passes.table, ProfileOptions(as_of=rules.as_of)))
    dropped: list[str] = []
    if drop_identifiers:
        candidates = {r["column"] for r in drop_candidates(after, passes.violations, target, rules.leaky).collect()}
        measured = {c for c, t in passes.table.dtypes if t in MEASURED}
        dropped = sorted((candidates - measured) & set(passes.table.columns) - {key, target})
    slim = passes.table.drop(*dropped)

    def propose(table: DataFrame, number: int) -> list[FeatureStep]:
        if number > 1:
            return []
        if features is not None:
            return list(features)
        own = after.where(F.col("column").isin(*slim.columns) & (F.col("column") != key))
        return propose_features(own, target, table.columns, number)

    rounds = run_rounds(slim, target, propose)
    counts = {c: _written_counts(frame) for c, frame in fit(rounds.steps, slim).items()}
    state = FitState(target, key, [*declared, *passes.steps], dropped, rounds.steps, counts)
    return Fitted(state, passes, rounds, state.derive(slim))


def _written_counts(frame: DataFrame) -> DataFrame:
    path = scratch_path(frame.sparkSession, "counts")
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)
