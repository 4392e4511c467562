"""Feature recipes: typed steps that add one column each, linted for leakage, run in rounds, replayed on folds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators import features as fx
from siltworks.operators.inference import CATEGORICAL, DATETIME, NUMERIC
from siltworks.plans.lineage import step_facts
from siltworks.plans.recipe import RecipeError

# The feature operations and the limits of a run.
OPERATIONS = ("NUMERIC_TRANSFORM", "INTERACTION", "BINNING", "DATETIME_EXPAND", "CATEGORY_ENCODE", "AGGREGATION", "TEXT_FEATURE", "CUSTOM_FEATURE")
MAX_ROUNDS, MAX_PER_ROUND = 3, 8
SKEWED, MANY_VALUES, LONG_TEXT = 1.0, 50, 40


@dataclass(frozen=True)
class FeatureStep:
    """One new column. ``params`` holds ``kind`` and what the kind needs."""

    new_column: str
    operation: str
    sources: tuple[str, ...]
    params: dict = field(default_factory=dict)
    round_number: int = 1
    justification: str = ""

    def __post_init__(self) -> None:
        if self.operation not in OPERATIONS:
            raise RecipeError(f"unknown feature operation: {self.operation}")

    @property
    def fitted(self) -> bool:
        """True for frequency encoding, the only step that looks at more than one row."""
        return self.operation == "CATEGORY_ENCODE" and self.params.get("kind", "frequency") == "frequency"

    def column(self) -> Column:
        p, kind = self.params, self.params.get("kind")
        if self.operation == "NUMERIC_TRANSFORM":
            return fx.numeric_transform(self.sources[0], kind, p.get("exponent", 2.0))
        if self.operation == "INTERACTION":
            return fx.interaction(self.sources[0], self.sources[1], kind)
        if self.operation == "BINNING":
            return fx.binned(self.sources[0], p["edges"], p.get("labels"))
        if self.operation == "DATETIME_EXPAND":
            return fx.date_part(self.sources[0], kind)
        if self.operation == "CATEGORY_ENCODE":
            return fx.hash_encoded(self.sources[0], p["buckets"])
        if self.operation == "AGGREGATION":
            return fx.row_aggregate(list(self.sources), kind)
        if self.operation == "TEXT_FEATURE":
            return fx.text_measure(self.sources[0], kind, p.get("pattern", ""))
        return F.expr(p["sql"])

    def apply(self, df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
        if self.fitted:
            return fx.frequency_encoded(df, self.sources[0], self.new_column, counts)
        return df.withColumn(self.new_column, self.column())


def leaks(step: FeatureStep, df: DataFrame, target: str | None) -> bool:
    """True when the step makes the target or reads it, directly or through a column that was made of it.

    Read off the analysed plan, so that ``struct(*)`` or another spelling of the name cannot hide it.
    """
    if target is None:
        return False
    if step.new_column == target or target in step.sources:
        return True
    if step.fitted or target not in df.columns:
        return False
    try:
        return target in step_facts(df, step.apply(df)).reads.get(step.new_column, frozenset())
    except PySparkException:
        return False


def leakage_lint(steps: list[FeatureStep], df: DataFrame, target: str | None) -> list[FeatureStep]:
    """The steps that neither read nor make the target."""
    kept, known = [], df
    for s in steps:
        if leaks(s, known, target):
            continue
        kept.append(s)
        if not s.fitted:
            try:
                known = s.apply(known)
            except PySparkException:
                pass
    return kept


@dataclass(frozen=True)
class FeatureProblem:
    new_column: str
    rule: str
    text: str

    def __str__(self) -> str:
        return f"{self.new_column} {self.text}"


def additivity_problems(steps: list[FeatureStep], df: DataFrame) -> list[str]:
    return [str(p) for p in feature_problems(steps, df)]


def feature_problems(steps: list[FeatureStep], df: DataFrame, target: str | None = None) -> list[FeatureProblem]:
    """Each step adds exactly one new column, keeps the others, looks at single rows only and gives the same every time.

    With a ``target`` steps that read it are reported as well. Frequency encoding is the one step that may look at all
    rows: its counts come from the training fold.
    """
    problems: list[FeatureProblem] = []
    table, names = df, list(df.columns)
    for s in steps:
        there = s.new_column in table.columns
        if there:
            problems.append(FeatureProblem(s.new_column, "new", "exists already"))
        if target is not None and leaks(s, table, target):
            problems.append(FeatureProblem(s.new_column, "leak", f"reads the target {target}"))
        if s.fitted:
            table = table if there else table.withColumn(s.new_column, F.lit(0).cast("long"))
            names += [] if there else [s.new_column]
            continue
        try:
            after = s.apply(table)
            facts = step_facts(table, after)
        except (PySparkException, KeyError, ValueError) as error:
            problems.append(FeatureProblem(s.new_column, "resolves", f"does not resolve: {error}"))
            continue
        for broken, rule, text in (
            (facts.whole_table or facts.generates, "row", "looks at more than its row"),
            (not facts.deterministic, "repeatable", "does not give the same again"),
            (facts.timed, "repeatable", "depends on when it runs"),
            (facts.opaque, "opaque", "uses a function nobody can look into"),
        ):
            if broken:
                problems.append(FeatureProblem(s.new_column, rule, text))
        names += [] if there else [s.new_column]
        if after.columns != names:
            problems.append(FeatureProblem(s.new_column, "columns", f"changes the columns to {after.columns}"))
            names = list(after.columns)
        table = after
    return problems


def feature_lint_table(steps: list[FeatureStep], df: DataFrame, target: str | None = None) -> DataFrame:
    """One row per problem of a feature step, and one for each step without any, beside the values it would add.

    ``values`` counts the rows of ``df`` to which the step gives a value, for all steps in one scan; steps that look beyond their
    row, or do not resolve, have no count.
    """
    problems = feature_problems(steps, df, target)
    barred = {p.new_column for p in problems if p.rule in ("row", "resolves", "new")}
    rows, counts, table = [], [], df
    for i, s in enumerate(steps):
        own = [p for p in problems if p.new_column == s.new_column]
        rows += [(i + 1, s.new_column, p.rule, p.text) for p in own] or [(i + 1, s.new_column, "none", "nothing to object to")]
        if s.new_column not in barred and not s.fitted:
            table = s.apply(table)
            counts.append(F.struct(F.lit(i + 1).alias("position"), F.count(F.col(f"`{s.new_column}`")).alias("values")))
    out = df.sparkSession.createDataFrame(rows, "position int, new_column string, rule string, problem string")
    if not counts:
        return out.withColumn("values", F.lit(None).cast("long"))
    counted = table.agg(F.array(*counts).alias("all")).select(F.explode("all").alias("one")).select("one.*")
    return out.join(F.broadcast(counted), "position", "left")


def fit(steps: list[FeatureStep], train: DataFrame) -> dict[str, DataFrame]:
    """Counts of the training fold for each frequency-encoded source."""
    return {s.sources[0]: fx.value_counts(train, s.sources[0]) for s in steps if s.fitted}


def replay_features(steps: list[FeatureStep], df: DataFrame, fitted: dict[str, DataFrame] | None = None) -> DataFrame:
    """Steps on a fold or stream. With ``fitted`` frequencies come from training; without, they are counted anew."""
    out = df
    for s in steps:
        try:
            out = s.apply(out, (fitted or {}).get(s.sources[0]))
            out.schema  # noqa: B018
        except (PySparkException, KeyError, ValueError) as error:
            raise RecipeError(f"Feature {s.new_column} failed: {error}") from error
    return out


def propose_features(profile_rows: DataFrame, target: str | None, existing: list[str], round_number: int = 1) -> list[FeatureStep]:
    """Rule-based ideas from a profile: dates expand, skewed non-negative numbers get a log, long texts a length,

    categories with many values a frequency. Never the target, never a name that exists; at most eight per round.
    """
    ideas: list[FeatureStep] = []
    taken = set(existing)

    def add(name: str, operation: str, source: str, params: dict, why: str) -> None:
        if name not in taken and len(ideas) < MAX_PER_ROUND:
            taken.add(name)
            ideas.append(FeatureStep(name, operation, (source,), params, round_number, why))

    for r in profile_rows.orderBy("position").collect():
        c, kind = r["column"], r["inferred_type"]
        if c == target or r["type_mismatch"]:
            continue
        if kind == DATETIME:
            for part in ("month", "dayofweek", "is_weekend"):
                add(f"{c}_{part}", "DATETIME_EXPAND", c, {"kind": part}, "calendar effect")
        elif kind == NUMERIC and (r["skewness"] or 0) > SKEWED and (r["min"] or 0) >= 0:
            add(f"{c}_log1p", "NUMERIC_TRANSFORM", c, {"kind": "log1p"}, "long right tail")
        elif kind == CATEGORICAL and (r["max_length"] or 0) > LONG_TEXT:
            add(f"{c}_length", "TEXT_FEATURE", c, {"kind": "length"}, "free text")
        elif kind == CATEGORICAL and r["unique_count"] > MANY_VALUES:
            add(f"{c}_frequency", "CATEGORY_ENCODE", c, {"kind": "frequency"}, "many values")
    return ideas


@dataclass
class RoundsResult:
    table: DataFrame
    steps: list[FeatureStep]
    history: list[dict]
    skipped: str | None = None


def run_rounds(df: DataFrame, target: str | None, proposer, max_rounds: int = MAX_ROUNDS) -> RoundsResult:
    """Up to three rounds of ``proposer(table, round) -> steps``; an empty or failing round ends the run.

    Columns of earlier rounds stay. A round whose steps all read the target counts as empty.
    """
    if not df.columns or df.columns == [target]:
        return RoundsResult(df, [], [], "nothing but the target")
    if df.isEmpty():
        return RoundsResult(df, [], [], "empty table")
    table, committed, history = df, [], []
    for number in range(1, max_rounds + 1):
        proposed = proposer(table, number)
        safe = leakage_lint(proposed, table, target)
        problems = additivity_problems(safe, table)
        entry = {"round": number, "proposed": len(proposed), "kept": len(safe), "added": 0, "error": "; ".join(problems) or None}
        history.append(entry)
        if not safe or problems:
            break
        try:
            table = replay_features(safe, table)
        except RecipeError as error:
            entry["error"] = str(error)
            break
        committed += safe
        entry["added"] = len(safe)
    return RoundsResult(table, committed, history)
