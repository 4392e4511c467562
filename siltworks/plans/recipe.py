"""Cleaning recipes: declarative steps, linted, applied all-or-nothing, audited, replayable on any batch or stream."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators import cleaning as act
from siltworks.plans.lineage import ASKS_FOR_NULL, outcome_of_null, step_facts

# The operations, the spellings they are also known by, and the order of a recipe.
OPERATIONS = ("DROP_COLUMN", "DROP_ROWS", "RENAME_COLUMN", "CAST_TYPE", "CUSTOM_CODE")
ALIASES = {
    "DROP_COLUMNS": "DROP_COLUMN",
    "RENAME_COLUMNS": "RENAME_COLUMN",
    "DROP_ROW": "DROP_ROWS",
    "CAST_TYPES": "CAST_TYPE",
    "CUSTOM": "CUSTOM_CODE",
}
STEP_ORDER = ("drop columns", "casts", "sentinels", "non-finite", "target")
SUCCESS, FAILED = "SUCCESS", "FAILED"


class RecipeError(ValueError):
    """A recipe that is not allowed or does not resolve."""


@dataclass(frozen=True)
class Step:
    """One cleaning step. ``action`` names a cleaning action; ``params`` are its arguments."""

    step_id: int
    operation: str
    action: str
    column: str | None = None
    params: dict = field(default_factory=dict)
    addresses_violation: int | None = None
    justification: str = ""

    def __post_init__(self) -> None:
        name = self.operation.strip().upper()
        object.__setattr__(self, "operation", ALIASES.get(name, name))
        if self.operation not in OPERATIONS:
            raise RecipeError(f"unknown operation: {self.operation}")
        if self.action not in ACTIONS:
            raise RecipeError(f"unknown action: {self.action}")

    def apply(self, df: DataFrame) -> DataFrame:
        return ACTIONS[self.action](df, self)

    def code(self) -> str:
        return f"{self.action}({', '.join(map(str, [self.column or '', self.params or '']))})"


ACTIONS: dict[str, Callable[[DataFrame, Step], DataFrame]] = {
    "drop_columns": lambda df, s: act.drop_columns(df, s.params.get("columns") or [s.column]),
    "drop_rows": lambda df, s: act.drop_rows(df, s.params["condition"]),
    "rename": lambda df, s: act.rename_column(df, s.column, s.params["to"]),
    "cast": lambda df, s: act.cast_column(df, s.column, s.params["to"]),
    "expression": lambda df, s: act.set_expression(df, s.column, s.params["sql"]),
    "null_sentinels": lambda df, s: act.null_sentinels(df, s.column, s.params["values"]),
    "null_tokens": lambda df, s: act.null_tokens(df, s.column),
    "null_outside": lambda df, s: act.null_outside(df, s.column, s.params.get("low"), s.params.get("high")),
    "extract_units": lambda df, s: act.extract_units(df, s.column),
    "null_future_dates": lambda df, s: act.null_future_dates(df, s.column, s.params["as_of"]),
    "null_non_finite": lambda df, s: act.null_non_finite(df, s.column),
    "trim": lambda df, s: act.trim_text(df, s.column),
    "drop_missing_target": lambda df, s: act.drop_missing_target(df, s.column),
    "drop_duplicates": lambda df, s: act.drop_duplicate_rows(df, s.params.get("keys"), s.params.get("order")),
}
_STAGE = {
    "drop_columns": 0,
    "rename": 1,
    "cast": 1,
    "extract_units": 1,
    "null_tokens": 2,
    "null_sentinels": 2,
    "null_outside": 2,
    "null_future_dates": 2,
    "trim": 2,
    "expression": 2,
    "drop_rows": 2,
    "drop_duplicates": 2,
    "null_non_finite": 3,
    "drop_missing_target": 4,
}


def ordered(steps: list[Step]) -> list[Step]:
    """Steps in canonical order, renumbered; the order within a stage is kept."""
    placed = sorted(steps, key=lambda s: _STAGE[s.action])
    return [replace(s, step_id=i + 1) for i, s in enumerate(placed)]


@dataclass(frozen=True)
class Problem:
    """What is wrong with one step, or (step 0) with a recipe as a whole."""

    step_id: int
    rule: str
    columns: tuple[str, ...]
    text: str

    def __str__(self) -> str:
        return f"step {self.step_id} {self.text}" if self.step_id else self.text


def lint(steps: list[Step], df: DataFrame, target: str | None = None, pairs: list[tuple[str, str]] | None = None, flagged: set[str] | None = None) -> list[str]:
    """The problems of a recipe as sentences; an empty list is a clean recipe. Nothing is executed."""
    return [str(p) for p in problems_of(steps, df, target, pairs, flagged)]


def problems_of(steps: list[Step], df: DataFrame, target: str | None = None, pairs: list[tuple[str, str]] | None = None, flagged: set[str] | None = None) -> list[Problem]:
    """Everything that is wrong with a recipe, judged by the plan each step resolves to and not by its text.

    No new columns, no filling of gaps, no statistics of the whole table, nothing random, opaque or dependent on the hour, no
    rescaling, no row drop on missing features; the target stays what it is, and the steps keep their order. A partner
    of a paired measurement is only nulled when it was flagged itself.
    """
    problems: list[Problem] = []

    def report(step_id: int, rule: str, columns, text: str) -> None:
        problems.append(Problem(step_id, rule, tuple(columns), text))

    stages = [_STAGE[s.action] for s in steps]
    if stages != sorted(stages):
        report(0, "order", (), f"steps are not in order: {' -> '.join(STEP_ORDER)}")
    for s in steps:
        touched = s.params.get("columns") or [s.column]
        if target is not None and s.action in ("drop_columns", "rename") and target in touched:
            report(s.step_id, "target", (target,), f"drops or renames the target {target}")
        if s.action == "drop_missing_target" and target is not None and s.column != target:
            report(s.step_id, "row drop", (s.column,), f"drops rows on missing {s.column}, which is not the target")
    for a, b in pairs or []:
        nulled = {s.column for s in steps if s.action in ("null_outside", "null_sentinels")}
        if {a, b} <= nulled and flagged is not None and not {a, b} <= flagged:
            report(0, "pair", (a, b), f"both sides of the pair {a}, {b} are nulled but only one was flagged")
    table, resolved = df, True
    for s in steps:
        try:
            after = resolve([s], table)
        except (RecipeError, PySparkException, KeyError, ValueError) as error:
            report(s.step_id, "resolves", (), f"does not resolve: {error}")
            resolved = False
            break
        for rule, columns, text in _plan_problems(s, table, after, target):
            report(s.step_id, rule, columns, text)
        table = after
    if not resolved:
        return problems
    renamed = {s.params["to"] for s in steps if s.action == "rename"}
    added = set(table.columns) - set(df.columns) - renamed
    if added:
        report(0, "columns", sorted(added), f"adds columns: {sorted(added)}")
    if target is not None and target not in table.columns:
        report(0, "target", (target,), f"target {target} does not survive")
    return problems


def _plan_problems(s: Step, before: DataFrame, after: DataFrame, target: str | None) -> list[tuple[str, tuple[str, ...], str]]:
    """The rules about a step's plan. Only free SQL can break most of them; the named actions go through the same questions."""
    facts, out = step_facts(before, after), []
    free = s.action in ("expression", "drop_rows")
    if facts.whole_table and s.action != "drop_duplicates":
        out.append(("whole table", (), "uses statistics of the whole table"))
    if not facts.deterministic or facts.timed:
        out.append(("repeatable", (), "does not give the same again" if not facts.deterministic else "depends on when it runs"))
    if facts.opaque:
        out.append(("opaque", (), "uses a function nobody can look into"))
    if target in facts.after and target in facts.changed and target in facts.before:
        was, now = facts.before[target], facts.after[target]
        if now == "string" != was:
            out.append(("target", (target,), f"turns the target {target} into text"))
        elif free and now != was:
            out.append(("target", (target,), f"changes the type of the target {target}"))
        if free and target not in facts.reads[target]:
            out.append(("target", (target,), f"replaces the target {target}"))
    if s.action == "expression" and s.column in facts.before and s.column in facts.changed:
        filled = outcome_of_null(before, s.apply, s.column, s.column)
        if filled == "value" or filled == "open" and facts.kinds & ASKS_FOR_NULL:
            out.append(("fill", (s.column,), "fills missing values"))
        elif s.column not in facts.reads[s.column] and not facts.whole_table and s.column != target:
            out.append(("replace", (s.column,), f"puts something else in the place of {s.column}"))
        if {"Subtract", "Divide"} <= facts.kinds and not facts.kinds & {"If", "CaseWhen"} and facts.reads[s.column] == {s.column}:
            out.append(("scale", (s.column,), f"rescales {s.column}"))
    if s.action == "drop_rows":
        asked = facts.kinds & ASKS_FOR_NULL
        missing = [c for c in before.columns if c in facts.conditions and c != target and (asked and outcome_of_null(before, s.apply, c) != "null" or outcome_of_null(before, s.apply, c) == "value")]
        if missing:
            out.append(("row drop", tuple(missing), f"drops rows on missing {', '.join(missing)}"))
    return out


def lint_table(steps: list[Step], df: DataFrame, target: str | None = None, pairs: list[tuple[str, str]] | None = None, flagged: set[str] | None = None) -> DataFrame:
    """One row per problem of a step, and one for each step without any, beside the rows of ``df`` the step changes or drops.

    The plans are read on the driver; the rows are counted in one job, whatever the number of steps. A step that
    does not resolve, and those after it, have no count.
    """
    problems = problems_of(steps, df, target, pairs, flagged)
    spark, counted, table = df.sparkSession, None, df
    for s in steps:
        try:
            one = _touched(s, table).select(F.lit(s.step_id).alias("step_id"), F.col("n").alias("rows_touched"))
            table = resolve([s], table)
        except (RecipeError, PySparkException, KeyError, ValueError):
            break
        counted = one if counted is None else counted.unionByName(one)
    rows = [(s.step_id, s.operation, p.rule, list(p.columns), p.text) for s in steps for p in problems if p.step_id == s.step_id]
    clean = [(s.step_id, s.operation, "none", [], "nothing to object to") for s in steps if not any(p.step_id == s.step_id for p in problems)]
    rows += clean + [(0, "RECIPE", p.rule, list(p.columns), p.text) for p in problems if not p.step_id]
    out = spark.createDataFrame(rows, "step_id int, operation string, rule string, columns array<string>, problem string")
    return out.withColumn("rows_touched", F.lit(None).cast("long")) if counted is None else out.join(F.broadcast(counted), "step_id", "left")


def _touched(s: Step, before: DataFrame) -> DataFrame:
    """How many rows of its input a step drops, or changes in its column; columns that go are not counted as changes."""
    if s.operation == "DROP_ROWS":
        kept = resolve([s], before).agg(F.count(F.lit(1)).alias("kept"))
        return before.agg(F.count(F.lit(1)).alias("all")).select((F.col("all") - kept.scalar()).alias("n"))
    if s.operation in ("DROP_COLUMN", "RENAME_COLUMN"):
        return before.agg(F.lit(0).cast("long").alias("n"))
    copy = "_before"
    while copy in before.columns:
        copy += "_"
    after = resolve([s], before.withColumn(copy, F.col(f"`{s.column}`")))
    same = F.col(f"`{s.column}`").cast("string").eqNullSafe(F.col(copy).cast("string"))
    return after.agg(F.count_if(~same).alias("n"))


def resolve(steps: list[Step], df: DataFrame) -> DataFrame:
    """The lazy result; a step that does not resolve against its input fails here, before any job."""
    out = df
    for s in steps:
        try:
            out = s.apply(out)
            out.schema  # noqa: B018 - forces analysis of this step
        except (PySparkException, KeyError, ValueError) as error:
            raise RecipeError(f"step {s.step_id}, {s.operation}: {error}") from error
    return out


@dataclass
class Outcome:
    """What applying a recipe gave: the new table, or the old one and the error; and the log of the steps."""

    table: DataFrame
    log: list[dict]
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.error is None

    def audit(self) -> DataFrame:
        """The log as a table."""
        schema = (
            "timestamp string, step_id int, operation string, justification string, code_executed string, "
            "status string, rows_after long, error string"
        )
        names = [f.split()[0] for f in schema.split(", ")]
        return self.table.sparkSession.createDataFrame([tuple(e.get(n) for n in names) for e in self.log], schema)

    def rollup(self) -> DataFrame:
        return self.audit().groupBy("status").agg(F.count(F.lit(1)).alias("steps"))


def apply(steps: list[Step], df: DataFrame, materialise: Callable[[DataFrame], DataFrame] | None = None) -> Outcome:
    """All steps in order, or none: on failure the input table comes back with the error and the log so far.

    With ``materialise`` (for instance a checkpoint) the result is computed once, a failure of that job leaves the
    input untouched as well, and the log says how many rows each step left.
    """
    log: list[dict] = []
    after: list[DataFrame] = []
    out = df
    for s in steps:
        entry = {
            "timestamp": dt.datetime.now(dt.timezone.utc).isoformat(),
            "step_id": s.step_id,
            "operation": s.operation,
            "justification": s.justification,
            "code_executed": s.code(),
            "status": SUCCESS,
        }
        log.append(entry)
        try:
            out = resolve([s], out)
        except RecipeError as error:
            entry.update(status=FAILED, error=str(error))
            return Outcome(df, log, str(error))
        after.append(out)
    if materialise is not None and steps:
        try:
            out = materialise(out)
        except PySparkException as error:
            log[-1].update(status=FAILED, error=str(error))
            return Outcome(df, log, str(error))
        for entry, rows in zip(log, _rows_after(steps, df, after, out)):
            entry["rows_after"] = rows
    return Outcome(out, log)


def _rows_after(steps: list[Step], before: DataFrame, after: list[DataFrame], result: DataFrame) -> list[int]:
    """Rows left by each step. Only steps that drop rows are counted, all in one job; the last one from the result."""
    dropping = [i for i, s in enumerate(steps) if s.operation == "DROP_ROWS"]
    tables = {-1: before if dropping else result}
    tables |= {i: result if i == dropping[-1] else after[i] for i in dropping}
    counted = None
    for i, table in tables.items():
        one = table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step"), "rows")
        counted = one if counted is None else counted.unionByName(one)
    rows = {r["step"]: r["rows"] for r in counted.collect()}
    return [rows[max(j for j in rows if j <= i)] for i in range(len(steps))]


def replay(steps: list[Step], df: DataFrame, target: str | None = None) -> DataFrame:
    """The same steps on another fold or on a stream; any error aborts, and the target must survive."""
    out = resolve(steps, df)
    if target is not None and target not in out.columns:
        raise RecipeError(f"the replayed steps lose the target {target}")
    return out


def steps_table(steps: list[Step], df: DataFrame) -> DataFrame:
    """Committed steps as an ordered table that can be written and read again."""
    rows = [(i + 1, s.step_id, s.operation, s.action, s.column, str(asdict(s)["params"]), s.addresses_violation, s.justification) for i, s in enumerate(steps)]
    schema = "position int, step_id int, operation string, action string, column string, params string, addresses_violation int, justification string"
    return df.sparkSession.createDataFrame(rows, schema)
