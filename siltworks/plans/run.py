"""One batch run: a raw table and a question to a clean table, features, a model and what to know about it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from siltworks.operators.profiling import ProfileOptions, profile
from siltworks.operators.quality import quality_score
from siltworks.operators.splitting import written_folds
from siltworks.operators.training import fit_best, model_metadata, permutation_importance, preflight, score
from siltworks.operators.violations import Rules, caveats, choose_target, findings_summary, target_candidates
from siltworks.plans.feature_rounds import FeatureStep
from siltworks.plans.fitted import fit_state
from siltworks.plans.passes import PassesResult
from siltworks.sources.writers import write_csv, write_json


@dataclass
class RunReport:
    """Everything a run leaves behind; tables are lazy unless a pass checkpointed them."""

    target: str
    profile: DataFrame
    quality: DataFrame
    passes: PassesResult
    dropped: list[str]
    features: list[FeatureStep]
    table: DataFrame
    caveats: DataFrame
    findings: DataFrame
    model: DataFrame | None = None
    test_score: float | None = None
    error: str | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def write(self, folder: str) -> None:
        """The clean table as delimited text, the reports as JSON."""
        write_csv(self.table, f"{folder}/cleaned", "overwrite")
        for name, frame in {"profile": self.profile, "findings": self.findings, "history": self.passes.history_table(), "model": self.model}.items():
            if frame is not None:
                write_json(frame, f"{folder}/{name}", "overwrite")


def run_table(df: DataFrame, key: str, question: str = "", target: str | None = None, rules: Rules | None = None, task_type: str | None = None, train: bool = True) -> RunReport:
    """Profile, choose the target, split, and learn cleaning, dropped columns and features from the training fold; train, score.

    ``key`` identifies the rows; it is kept for the folds and never a feature. ``rules`` are left as they are. Without ``train``
    there is no split, and the whole table is learnt from.
    """
    rules = rules or Rules()
    options = ProfileOptions(as_of=rules.as_of)
    first = profile(df, options)
    ranked = [] if target or rules.target else [r["column"] for r in target_candidates(first, question).collect()]
    chosen = choose_target(df.columns, ranked, rules.target, target)
    if chosen is None:
        raise ValueError("no column can be predicted")
    regression = task_type == "regression" or dict(df.dtypes)[chosen] == "double"
    folds = written_folds(df, key, None if regression else chosen) if train else [df]
    fitted = fit_state(folds[0], chosen, key, rules)
    state, passes = fitted.state, fitted.passes
    report = RunReport(
        chosen, first, quality_score(first, chosen), passes, state.dropped, state.features, state.transform(df), caveats(df, passes.violations), findings_summary(passes.violations)
    )
    if not train:
        return report
    report.error = preflight(fitted.table, chosen).first()["error"]
    if report.error is None:
        validation, test = (state.transform(f) for f in folds[1:])
        model = fit_best(fitted.table, validation, chosen, task_type, ignore=(key,))
        model.importance = permutation_importance(model, validation, key)
        report.model = model_metadata(model, df)
        report.test_score = score(model, test, model.metric)
    return report
