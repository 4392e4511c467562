"""Benchmark runs: a registry of labelled tables, each split first, then cleaned, featured and trained on its training fold alone."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.splitting import check_schema_drift, drop_declared, written_folds
from siltworks.operators.training import drop_invalid_target, fit_best, score
from siltworks.operators.violations import Rules
from siltworks.plans.feature_rounds import FeatureStep
from siltworks.plans.fitted import fit_state
from siltworks.plans.recipe import Step
from siltworks.session import cut_lineage

# The statuses a run can end with.
OK, GRAPH_FAILED, REPLAY_FAILED, FEATURES_FAILED, TRAINING_FAILED = "ok", "graph_failed", "replay_failed", "fe_replay_failed", "training_failed"
RESULT_SCHEMA = (
    "name string, status string, metric string, test_score double, val_score double, baseline double, delta double, "
    "n_train long, n_val long, n_test_input long, n_test_after_replay long, best_model string, training_seconds double, "
    "features_added int, error string"
)
STAGE_SCHEMA = "name string, position int, stage string, status string, rows long, seconds double, error string"


@dataclass
class Dataset:
    """One registry entry. ``load`` gives the labelled table; ``key`` identifies its rows.

    ``steps`` are cleaning steps known beforehand, ``features`` replace the proposed ones, ``rules`` guide the passes.
    """

    name: str
    load: object
    target: str
    task_type: str
    metric: str
    key: str
    drop: list[str] = field(default_factory=list)
    steps: list[Step] = field(default_factory=list)
    features: list[FeatureStep] | None = None
    baseline: float | None = None
    rules: Rules | None = None


class StageError(Exception):
    """A stage that failed; its status is the run's."""

    def __init__(self, status: str, error: Exception) -> None:
        super().__init__(f"{type(error).__name__}: {error}"[:500])
        self.status = status


@dataclass
class Run:
    """The result row of one dataset, and one row for each stage it reached."""

    result: dict
    stages: list[tuple]


def run_one(spark: SparkSession, ds: Dataset) -> Run:
    """Scores of one dataset; an error becomes its status.

    Every fold is computed before the next stage begins, so that a step which fails on one fold's values fails in its own
    stage. Only the training fold is looked at by the passes, the feature rounds and the encodings; the validation fold
    ranks the models; the test fold is cleaned, featured and scored.
    """
    out = {f.split()[0]: None for f in RESULT_SCHEMA.split(", ")}
    out.update(name=ds.name, status=OK, metric=ds.metric, baseline=ds.baseline)
    stages: list[tuple] = []

    def stage(name: str, status: str, work: Callable[[], tuple[object, int | None]]) -> object:
        t0 = time.perf_counter()
        try:
            value, rows = work()
        except Exception as error:  # noqa: BLE001 - one dataset must never stop the others
            failure = StageError(status, error)
            stages.append((ds.name, len(stages) + 1, name, status, None, time.perf_counter() - t0, str(failure)))
            raise failure from error
        stages.append((ds.name, len(stages) + 1, name, OK, rows, time.perf_counter() - t0, None))
        return value

    def split() -> tuple[list[DataFrame], int]:
        table = drop_declared(ds.load(spark), ds.drop)
        if ds.target not in table.columns:
            raise ValueError(f"the table has no target column {ds.target}")
        folds = written_folds(table, ds.key, ds.target if ds.task_type != "regression" else None)
        out.update(zip(("n_train", "n_val", "n_test_input"), map(_rows, folds)))
        return folds, out["n_train"] + out["n_val"] + out["n_test_input"]

    def both(change: Callable[[DataFrame], DataFrame], frames: list[DataFrame]) -> tuple[list[DataFrame], int]:
        done = [cut_lineage(change(f)) for f in frames]
        return done, sum(map(_rows, done))

    def train(clean: DataFrame, val: DataFrame) -> tuple[object, int]:
        model = fit_best(clean, val, ds.target, ds.task_type, ds.metric, ignore=(ds.key,))
        return model, model.rows

    def scored(model, test: DataFrame) -> tuple[float, int]:
        usable = drop_invalid_target(test, ds.target)
        return float(score(model, usable, ds.metric)), _rows(usable)

    try:
        folds = stage("split", GRAPH_FAILED, split)
        fitted = stage("fit", GRAPH_FAILED, lambda: _counted(fit_state(folds[0], ds.target, ds.key, ds.rules, ds.steps, ds.features)))
        cleaned = stage("replay", REPLAY_FAILED, lambda: both(fitted.state.clean, folds[1:]))
        out["features_added"] = len(fitted.state.features)
        val, test = stage("features", FEATURES_FAILED, lambda: both(fitted.state.derive, cleaned))
        out["n_test_after_replay"] = _rows(test)
        for name, fold in (("val", val), ("test", test)):
            check_schema_drift(fitted.table, fold, name)
        model = stage("train", TRAINING_FAILED, lambda: train(fitted.table, val))
        out.update(val_score=float(model.leaderboard[0][1]), best_model=model.best, training_seconds=model.seconds)
        value = stage("score", TRAINING_FAILED, lambda: scored(model, test))
        out.update(test_score=value, delta=None if ds.baseline is None else value - ds.baseline)
    except StageError as failure:
        out.update(status=failure.status, error=str(failure))
    except Exception as error:  # noqa: BLE001
        out.update(status=GRAPH_FAILED, error=f"{type(error).__name__}: {error}"[:500])
    return Run(out, stages)


def _rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def _counted(fitted) -> tuple[object, int]:
    return fitted, _rows(fitted.passes.table)


def runs(spark: SparkSession, registry: list[Dataset], only: str | None = None) -> list[Run]:
    chosen = [d for d in registry if only in (None, d.name)]
    if not chosen:
        raise ValueError(f"no dataset named '{only}': {[d.name for d in registry]}")
    return [run_one(spark, d) for d in chosen]


def run(spark: SparkSession, registry: list[Dataset], only: str | None = None) -> DataFrame:
    """One result row per dataset, or for the named one."""
    return spark.createDataFrame([tuple(r.result.values()) for r in runs(spark, registry, only)], RESULT_SCHEMA)


def run_stages(spark: SparkSession, registry: list[Dataset], only: str | None = None) -> DataFrame:
    """One row per dataset and stage it reached: status, rows it left, seconds, error."""
    return spark.createDataFrame([row for r in runs(spark, registry, only) for row in r.stages], STAGE_SCHEMA)


def formatted(results: DataFrame) -> DataFrame:
    """Scores with three decimals, signed differences, ``n/a`` for what is missing."""
    def text(c: str):
        return F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("n/a")) if c != "delta" else F.coalesce(F.format_string("%+.3f", F.col(c)), F.lit("n/a"))

    def known(c: str):
        return F.when(F.col(c).isNull(), F.lit("n/a")).otherwise(text(c))

    return results.select("name", "metric", *[known(c).alias(c) for c in ("test_score", "val_score", "baseline", "delta")], "status")
