"""What a step does to a table, read off Spark's analysed plan: which columns feed which, and what kind of work it is.

Texts of expressions say little (``isnull(x)``, ``x is null`` and ``x <=> null`` are one thing); the resolved plan says
what is read, whether a result repeats, and whether a row is looked at alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Expressions that look beyond their row, that make rows, that nobody can look into, and whose value depends on when they run.
WHOLE_TABLE = {"WindowExpression", "AggregateExpression", "ScalarSubquery", "InSubquery", "Exists", "ListQuery", "LateralSubquery"}
OPAQUE = {"PythonUDF", "ScalaUDF", "PythonUDAF", "PythonUDTF", "UserDefinedExpression"}
TIMED = {"CurrentDate", "CurrentTimestamp", "CurrentTimestampLike", "Now", "LocalTimestamp", "CurrentTime"}
# Expressions that tell a missing value from others.
ASKS_FOR_NULL = {"IsNull", "IsNotNull", "EqualNullSafe", "Coalesce", "AtLeastNNonNulls", "NullIf"}
ELSEWHERE = "(another table)"


@dataclass(frozen=True)
class StepFacts:
    """``reads``: for each column of the result, the columns it is made of; ``kinds``: expressions the step adds."""

    reads: dict[str, frozenset[str]]
    kinds: frozenset[str]
    nodes: frozenset[str]
    deterministic: bool
    before: dict[str, str]
    after: dict[str, str]
    carried: frozenset[str]
    conditions: frozenset[str]

    @property
    def changed(self) -> set[str]:
        """Columns that are new or computed, not carried through."""
        return set(self.after) - self.carried

    @property
    def whole_table(self) -> bool:
        return bool(self.kinds & WHOLE_TABLE) or bool(self.nodes & {"Window", "Aggregate", "Join", "Distinct", "Deduplicate"})

    @property
    def generates(self) -> bool:
        return "Generate" in self.nodes

    @property
    def opaque(self) -> bool:
        return bool(self.kinds & OPAQUE)

    @property
    def timed(self) -> bool:
        return bool(self.kinds & TIMED)


def _each(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _tree(expression) -> Iterator:
    yield expression
    for child in _each(expression.children()):
        yield from _tree(child)


def _fed_by(expression, known: dict[int, frozenset[str]]) -> frozenset[str]:
    out: set[str] = set()
    for e in _tree(expression):
        if _name(e) == "AttributeReference":
            out |= known.get(e.exprId().id(), frozenset({ELSEWHERE}))
    return frozenset(out)


def step_facts(before: DataFrame, after: DataFrame) -> StepFacts:
    """What happens between two tables, read off the analysed plan of ``after`` down to that of ``before``. No job runs."""
    base, top = before._jdf.queryExecution().analyzed(), after._jdf.queryExecution().analyzed()
    names = {a.exprId().id(): a.name() for a in _each(base.output())}
    known = {i: frozenset({n}) for i, n in names.items()}
    kinds: set[str] = set()
    nodes: set[str] = set()
    conditions: set[str] = set()
    steady = True

    def visit(node) -> None:
        nonlocal steady
        if node.equals(base):
            return
        for child in _each(node.children()):
            visit(child)
        nodes.add(_name(node))
        fed: set[str] = set()
        for e in _each(node.expressions()):
            reads = _fed_by(e, known)
            fed |= reads
            for x in _tree(e):
                kind = _name(x)
                if kind == "Alias":
                    known[x.exprId().id()] = _fed_by(x, known)
                kinds.add(kind)
                steady &= bool(x.deterministic())
        if _name(node) in ("Filter", "Join"):
            conditions.update(fed)
        if node.children().size():
            for a in _each(node.output()):
                known.setdefault(a.exprId().id(), frozenset(fed) or frozenset({ELSEWHERE}))

    visit(top)
    outputs = {a.name(): a.exprId().id() for a in _each(top.output())}
    return StepFacts(
        {n: known.get(i, frozenset({ELSEWHERE})) for n, i in outputs.items()},
        frozenset(kinds),
        frozenset(nodes),
        steady,
        dict(before.dtypes),
        dict(after.dtypes),
        frozenset(n for n, i in outputs.items() if names.get(i) == n),
        frozenset(conditions),
    )


def outcome_of_null(before: DataFrame, step, column: str, result: str | None = None) -> str:
    """What ``step`` makes of a row whose ``column`` is missing, as far as Spark can work it out: null, value, or open.

    The column is put to a null literal and the optimiser folds what follows from it. With a ``result`` column the answer is
    about its value; without, about the step's condition: *value* then means that such a row is dropped whatever else it holds.
    """
    kind = before.schema[column].dataType
    blank = before.withColumn(column, F.lit(None).cast(kind))
    plan = step(blank)._jdf.queryExecution().optimizedPlan()
    if result is None:
        if _name(plan) == "LocalRelation" and plan.data().isEmpty():
            return "value"
        return "open" if any(_name(n) == "Filter" for n in _plans(plan)) else "null"
    wanted = {a.exprId().id() for a in _each(plan.output()) if a.name() == result}
    for node in _plans(plan):
        for e in _each(node.expressions()):
            for x in _tree(e):
                if _name(x) == "Alias" and x.exprId().id() in wanted:
                    inner = x.child()
                    if _name(inner) == "Literal":
                        return "null" if inner.value() is None else "value"
                    return "open"
    return "open"


def _plans(plan) -> Iterator:
    yield plan
    for child in _each(plan.children()):
        yield from _plans(child)
