"""Cleaning in passes: profile, detect, propose, apply, until nothing critical is left."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from siltworks.operators.inference import inferred_map, repeated_texts
from siltworks.operators.violations import CRITICAL, Rules, detect
from siltworks.plans.recipe import Step, apply, lint, ordered
from siltworks.session import cut_lineage

# Fixed value: cap on passes.
MAX_PASSES = 5
PERSONAL = "PII_DETECTED"
NEW, PERSISTS, REPAIRED = "new", "persists", "repaired"
LEDGER_SCHEMA = "pass_number int, severity string, category string, subtype string, columns string, n_rows long, rows_before long, status string"


@dataclass
class PassesResult:
    """The cleaned table, the steps that were committed over all passes, and one history line per pass."""

    table: DataFrame
    steps: list[Step]
    history: list[dict]
    violations: DataFrame
    ledger: list[tuple] = field(default_factory=list)

    def ledger_table(self) -> DataFrame:
        """Every finding of every pass: new, repaired since the pass before (and no longer reported), or persisting."""
        return self.table.sparkSession.createDataFrame(self.ledger, LEDGER_SCHEMA)

    def history_table(self) -> DataFrame:
        schema = "pass_number int, violations_found int, critical int, steps_executed int, rows_after long"
        return self.table.sparkSession.createDataFrame([tuple(h.values()) for h in self.history], schema)


def propose(found: list[Row], rules: Rules, types: dict[str, str], columns: list[str]) -> list[Step]:
    """Steps for the violations a rule can repair: casts, sentinels and impossible values to null, target drop last."""
    steps: list[Step] = []
    done: set[tuple] = set()

    def add(operation: str, action: str, column: str | None, params: dict, v: Row) -> None:
        mark = (action, column, str(params))
        if mark not in done and (column is None or column in columns):
            done.add(mark)
            steps.append(Step(0, operation, action, column, params, v["violation_id"], v["description"]))

    for v in found:
        names, kind, subtype = v["affected_columns"], v["category"], v["subtype"]
        column = names[0] if names else None
        if kind == PERSONAL and column != rules.target:
            add("DROP_COLUMN", "drop_columns", column, {}, v)
        elif kind == "TYPE_ERROR" and subtype == "UNIT_SUFFIX" and v["severity"] != CRITICAL:
            continue
        elif kind == "TYPE_ERROR" and subtype == "UNIT_SUFFIX" and types[column] != "Datetime":
            add("CUSTOM_CODE", "extract_units", column, {}, v)
        elif kind == "TYPE_ERROR" and types[column] == "Numeric":
            add("CUSTOM_CODE", "extract_units", column, {}, v)
        elif kind == "TYPE_ERROR" and types[column] == "Datetime":
            add("CAST_TYPE", "cast", column, {"to": "timestamp"}, v)
        elif kind == "SENTINEL_VALUE" and "infinite" in v["description"]:
            add("CUSTOM_CODE", "null_non_finite", column, {}, v)
        elif kind == "SENTINEL_VALUE" and "texts" in v["description"]:
            add("CUSTOM_CODE", "null_tokens", column, {}, v)
        elif kind == "SENTINEL_VALUE" and column in rules.sentinels:
            add("CUSTOM_CODE", "null_sentinels", column, {"values": rules.sentinels[column]}, v)
        elif kind == "OUTLIER" and subtype == "IMPOSSIBLE":
            low, high = rules.ranges[column]
            add("CUSTOM_CODE", "null_outside", column, {"low": low, "high": high}, v)
        elif kind == "OUTLIER" and subtype == "TEMPORAL":
            add("CUSTOM_CODE", "null_future_dates", column, {"as_of": str(rules.as_of)}, v)
        elif kind == "MISSING_DATA":
            add("CUSTOM_CODE", "null_non_finite", column, {}, v)
            add("DROP_ROWS", "drop_missing_target", column, {}, v)
    dropped = {s.column for s in steps if s.action == "drop_columns"}
    steps = [s for s in steps if s.action == "drop_columns" or s.column not in dropped]
    nulls_target = any(s.column == rules.target and s.action != "drop_missing_target" for s in steps)
    if rules.target and nulls_target and not any(s.action == "drop_missing_target" for s in steps):
        steps.append(Step(0, "DROP_ROWS", "drop_missing_target", rules.target, {}, None, "target may have become null"))
    return ordered(steps)


def finding_key(v: Row) -> tuple:
    return v["category"], v["subtype"] or "", ",".join(sorted(v["affected_columns"])), v["description"]


def compare_findings(number: int, found: list[Row], before: dict[tuple, Row]) -> list[tuple]:
    """The ledger lines of a pass: its findings, and those of the pass before whose evidence is gone."""
    now = {finding_key(v): v for v in found}
    lines = []
    for key, v in now.items():
        earlier = before.get(key)
        lines.append((number, v["severity"], v["category"], v["subtype"], key[2], v["n_rows"], earlier and earlier["n_rows"], PERSISTS if earlier else NEW))
    for key, v in before.items():
        if key not in now:
            lines.append((number, v["severity"], v["category"], v["subtype"], key[2], 0, v["n_rows"], REPAIRED))
    return lines


def clean_in_passes(df: DataFrame, rules: Rules, max_passes: int = MAX_PASSES) -> PassesResult:
    """Passes until one finds nothing critical, has nothing to repair, or the cap is reached.

    A pass with a critical finding is always followed by another one. Each pass ends in a checkpoint, so lineage
    stays short and a lost executor does not replay earlier passes. Only steps that were applied are kept. The ledger holds
    each pass's findings against the pass before: a repaired one is not reported again, and a step that left its finding
    where it was is not tried a second time.
    """
    table, committed, history, ledger = df, [], [], []
    violations, before = None, {}
    for number in range(max_passes):
        repeated = repeated_texts(table)
        types = inferred_map(table, repeated=repeated)
        # A bounded list: at most a few checks per column. It is written, since it is read more than once.
        violations = cut_lineage(detect(table, rules, types, repeated=repeated))
        found = violations.collect()
        ledger += compare_findings(number, found, before)
        persisting = {finding_key(v) for v in found} & set(before)
        before = {finding_key(v): v for v in found}
        critical = sum(v["severity"] == CRITICAL for v in found)
        tried = {(s.action, s.column, str(s.params)) for s in committed}
        stuck = {v["violation_id"] for v in found if finding_key(v) in persisting}
        steps = propose(found, rules, types, table.columns)
        steps = ordered([s for s in steps if s.addresses_violation not in stuck or (s.action, s.column, str(s.params)) not in tried])
        problems = lint(steps, table, rules.target)
        outcome = None if problems or not steps else apply(steps, table, cut_lineage)
        done = outcome is not None and outcome.ok
        if done:
            table = outcome.table
            committed += steps
        history.append(
            {
                "pass_number": number,
                "violations_found": len(found),
                "critical": critical,
                "steps_executed": len(steps) if done else 0,
                "rows_after": table.agg(F.count(F.lit(1))).first()[0],
            }
        )
        if not critical or not done:
            break
    return PassesResult(table, committed, history, violations, ledger)
