"""Model selection on an explicit validation fold with Spark ML, held-out scoring, permutation importance."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.dates import timestamp_of
from siltworks.functions.hashing import seeded_md5
from siltworks.functions.numbers import NATIVE_NUMERIC, number_of
from siltworks.functions.strings import canonical_text
from siltworks.operators.encoding import CategoryEncoding, fit_categories
from siltworks.operators.inference import quoted
from siltworks.operators.scoring import accuracy, auc_by_group, class_f1, macro_f1, rmse, roc_auc, roc_auc_ovr

# Task names, the metric each task is selected by, and the limits of the report.
TASKS = {"binary_classification": "binary", "multiclass_classification": "multiclass", "regression": "regression"}
DEFAULT_METRIC = {"binary": "roc_auc", "multiclass": "macro_f1", "regression": "rmse"}
LOWER_IS_BETTER = ("rmse",)
MIN_ROWS, LEADERBOARD, IMPORTANCE_ROWS, TOP_FEATURES = 10, 10, 1_000, 10
FEW_CLASSES = 20


def problem_type(task_type: str | None) -> str | None:
    """Free-text task name to a problem type; an unknown one is None (detect from the target)."""
    return TASKS.get(task_type.strip().lower().replace(" ", "_")) if task_type else None


def few_values(df: DataFrame, column: str, most: int) -> int:
    """The number of different values where there are at most ``most``; ``most`` + 1 or more where there are more.

    A sketch settles the many; only where it says that there may be few are values shuffled, and then few of them.
    """
    c = quoted(column)
    guess = df.agg(F.approx_count_distinct(c, 0.05)).first()[0]
    if guess > 2 * most + 10:
        return most + 1
    return df.where(c.isNotNull()).groupBy(c).agg(F.count(F.lit(1))).count()


def detect_problem_type(df: DataFrame, target: str) -> str:
    """Two values are binary; text or few whole values multiclass; everything else regression."""
    dtype = df.schema[target].dataType
    distinct = few_values(df, target, FEW_CLASSES)
    if distinct == 2:
        return "binary"
    whole = isinstance(dtype, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return "multiclass" if isinstance(dtype, (T.StringType, T.BooleanType)) or (whole and distinct <= FEW_CLASSES) else "regression"


def valid_target(df: DataFrame, target: str) -> Column:
    """True where the target can be trained on: not null and finite."""
    dtype = df.schema[target].dataType
    if isinstance(dtype, NATIVE_NUMERIC):
        return number_of(target, dtype).isNotNull()
    return quoted(target).isNotNull()


def preflight(df: DataFrame, target: str | None) -> DataFrame:
    """One row: the first reason not to train, or null; with the row counts behind it. One aggregate."""
    spark = df.sparkSession
    schema = "error string, rows long, usable_rows long, dropped_rows long"
    if target is None:
        return spark.createDataFrame([("no target named", None, None, None)], schema)
    if target not in df.columns:
        return spark.createDataFrame([(f"the table has no target column '{target}'", None, None, None)], schema)
    c = quoted(target)
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(valid_target(df, target)).alias("usable_rows"),
        F.coalesce(F.min(c) < F.max(c), F.lit(False)).alias("varies"),
    )
    rows, usable = F.col("rows"), F.col("usable_rows")
    error = (
        F.when(rows < MIN_ROWS, F.concat(rows.cast("string"), F.lit(f" rows where training takes {MIN_ROWS}")))
        .when(~F.col("varies"), f"target '{target}' never varies")
        .when(usable < MIN_ROWS, F.concat(usable.cast("string"), F.lit(f" rows with a finite target where training takes {MIN_ROWS}")))
    )
    return wide.select(error.alias("error"), "rows", "usable_rows", (rows - usable).alias("dropped_rows"))


def drop_invalid_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(valid_target(df, target))


@dataclass
class TrainedModel:
    """A fitted pipeline beside what is known about it."""

    target: str
    problem: str
    metric: str
    best: str
    pipeline: PipelineModel
    features: list[str]
    labels: list[str]
    leaderboard: list[tuple[str, float, float]]
    seconds: float
    rows: int
    encoding: CategoryEncoding
    importance: dict[str, float] = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and, for classification, ``probability`` (array in the order of ``labels``)."""
        out = self.pipeline.transform(self.encoding.transform(typed_features(df, self.features, self.target)))
        if self.problem == "regression":
            return out.withColumn("label", F.col("_y"))
        out = out.withColumn("probability", vector_to_array("probability")).withColumn("label", F.col("_y"))
        return IndexToString(inputCol="_prediction", outputCol="prediction", labels=self.labels).transform(out)


def typed_features(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Features as double or text under stable names, the target as ``_y``; other columns (a key) stay."""
    out = {}
    for i, c in enumerate(features):
        dtype = df.schema[c].dataType
        if isinstance(dtype, NATIVE_NUMERIC):
            out[f"_n{i}"] = number_of(c, dtype)
        elif isinstance(dtype, T.BooleanType):
            out[f"_n{i}"] = quoted(c).cast("double")
        elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[f"_n{i}"] = timestamp_of(c, dtype).cast("double")
        else:
            out[f"_t{i}"] = F.coalesce(canonical_text(c, dtype), F.lit("(missing)"))
    if target in df.columns:
        dtype = df.schema[target].dataType
        out["_y"] = number_of(target, dtype) if isinstance(dtype, NATIVE_NUMERIC) else canonical_text(target, dtype)
    return df.withColumns(out)


def _candidates(problem: str, seed: int) -> dict[str, object]:
    common = {"featuresCol": "_x", "labelCol": "_label", "predictionCol": "_prediction" if problem != "regression" else "prediction"}
    if problem == "regression":
        return {
            "linear": LinearRegression(**common, regParam=0.01),
            "random_forest": RandomForestRegressor(**common, numTrees=30, maxDepth=8, seed=seed),
            "gradient_boosting": GBTRegressor(**common, maxIter=30, maxDepth=5, seed=seed),
        }
    models: dict[str, object] = {
        "logistic": LogisticRegression(**common, regParam=0.01),
        "random_forest": RandomForestClassifier(**common, numTrees=30, maxDepth=8, seed=seed),
    }
    if problem == "binary":
        models["gradient_boosting"] = GBTClassifier(**common, maxIter=30, maxDepth=5, seed=seed)
    return models


def score(model: TrainedModel, df: DataFrame, metric: str) -> float:
    """One held-out metric of a model, computed exactly over the whole fold."""
    predicted = model.predict(drop_invalid_target(df, model.target))
    return _score(predicted, model.problem, metric, model.labels)


def _score(predicted: DataFrame, problem: str, metric: str, labels: list[str]) -> float:
    y = F.col("_y").cast("string") if problem != "regression" else F.col("_y")
    if metric == "rmse":
        return rmse(predicted.select("_y", "prediction"), "_y", "prediction").first()[0]
    if metric == "roc_auc":
        wide = predicted.select(y.alias("label"), *[F.get("probability", F.lit(i)).alias(f"p{i}") for i in range(len(labels))])
        if problem == "binary":
            return roc_auc(wide, "label", f"p{len(labels) - 1}", labels[-1]).first()[0]
        return roc_auc_ovr(wide, "label", {k: f"p{i}" for i, k in enumerate(labels)}).first()[0]
    pairs = predicted.select(y.alias("label"), "prediction")
    if metric == "macro_f1":
        return macro_f1(pairs, "label", "prediction").first()[0]
    if metric == "accuracy":
        return accuracy(pairs, "label", "prediction").first()[0]
    raise ValueError(f"no such metric here: {metric}")


def fit_best(train: DataFrame, validation: DataFrame, target: str, task_type: str | None = None, metric: str | None = None, ignore: tuple[str, ...] = (), seed: int = 0) -> TrainedModel:
    """Fit every candidate on the training fold, rank them on the validation fold, keep the best."""
    problem = problem_type(task_type) or detect_problem_type(train, target)
    metric = metric or DEFAULT_METRIC[problem]
    features = [c for c in train.columns if c != target and c not in ignore]
    train = drop_invalid_target(train, target)
    typed = typed_features(train, features, target)
    numeric = [c for c in typed.columns if c.startswith("_n") and c[2:].isdigit()]
    texts = [c for c in typed.columns if c.startswith("_t") and c[2:].isdigit()]
    filled = [f"{c}_f" for c in numeric]
    labels: list[str] = []
    prepared = typed
    if problem == "regression":
        prepared = typed.withColumn("_label", F.col("_y"))
    else:
        prepared = typed.withColumn("_y", F.col("_y").cast("string"))
        indexer: StringIndexerModel = StringIndexer(inputCol="_y", outputCol="_label", stringOrderType="alphabetAsc").fit(prepared)
        labels = list(indexer.labelsArray[0])
        prepared = indexer.transform(prepared)
    encoding = fit_categories(prepared, texts, "_y", labels or None)
    stages: list[object] = [Imputer(inputCols=numeric, outputCols=filled, strategy="mean")] if numeric else []
    stages.append(VectorAssembler(inputCols=filled + encoding.outputs, outputCol="_x", handleInvalid="keep"))
    encoded = encoding.transform(prepared, "_y")
    base = Pipeline(stages=stages).fit(encoded)
    ready = base.transform(encoded).select("_x", "_label").persist()
    started = time.perf_counter()
    ranked: list[tuple[str, float, float, PipelineModel]] = []
    check = drop_invalid_target(validation, target)
    for name, estimator in _candidates(problem, seed).items():
        t0 = time.perf_counter()
        fitted = PipelineModel(stages=[base, estimator.fit(ready)])
        model = TrainedModel(target, problem, metric, name, fitted, features, labels, [], 0.0, 0, encoding)
        value = _score(model.predict(check), problem, metric, labels)
        ranked.append((name, value, time.perf_counter() - t0, fitted))
    rows = ready.count()
    ready.unpersist()
    ranked.sort(key=lambda r: r[1] if r[1] is not None else float("-inf"), reverse=metric not in LOWER_IS_BETTER)
    board = [(n, v, s) for n, v, s, _ in ranked[:LEADERBOARD]]
    return TrainedModel(target, problem, metric, ranked[0][0], ranked[0][3], features, labels, board, time.perf_counter() - started, rows, encoding)


def permutation_importance(model: TrainedModel, df: DataFrame, key: str, rows: int = IMPORTANCE_ROWS, seed: int = 0) -> dict[str, float]:
    """Drop of the metric when one feature is shuffled, on a seeded sample of at most ``rows`` rows; one scoring job.

    Empty where scoring fails: importance is an extra that a run does without.
    """
    try:
        return _importance(model, df, key, rows, seed)
    except PySparkException:
        return {}


def _importance(model: TrainedModel, df: DataFrame, key: str, rows: int, seed: int) -> dict[str, float]:
    """Every feature adds one shuffled copy of the sample; the copies are scored together and compared per feature."""
    usable = drop_invalid_target(df, model.target)
    sample = usable.orderBy(seeded_md5(quoted(key), seed), quoted(key)).limit(rows)
    place = sample.withColumn("_rn", F.row_number().over(W.orderBy(seeded_md5(quoted(key), seed), quoted(key)))).persist()
    copies = [place.drop("_rn").withColumn("_feature", F.lit(""))]
    for c in model.features:
        shuffled = place.select(F.row_number().over(W.orderBy(seeded_md5(F.concat(quoted(key).cast("string"), F.lit(c)), seed + 1))).alias("_rn"), quoted(c).alias("_v"))
        moved = place.join(F.broadcast(shuffled), "_rn").withColumn(c, F.col("_v")).drop("_rn", "_v")
        copies.append(moved.select(*sample.columns, F.lit(c).alias("_feature")))
    together = copies[0]
    for copy in copies[1:]:
        together = together.unionByName(copy)
    predicted = model.predict(together)
    scores = {r["_feature"]: r["s"] for r in _score_per_feature(predicted, model).collect()}
    place.unpersist()
    sign = -1.0 if model.metric in LOWER_IS_BETTER else 1.0
    return {c: sign * (scores[""] - scores[c]) for c in model.features if scores.get(c) is not None and scores.get("") is not None}


def _score_per_feature(predicted: DataFrame, model: TrainedModel) -> DataFrame:
    """The model's own metric for every shuffled feature: ``(_feature, s)``."""
    if model.metric == "rmse":
        return predicted.groupBy("_feature").agg(F.sqrt(F.avg(F.pow(F.col("_y") - F.col("prediction"), F.lit(2)))).alias("s"))
    truth = F.col("_y").cast("string")
    if model.metric == "accuracy":
        return predicted.groupBy("_feature").agg(F.avg((truth == F.col("prediction")).cast("double")).alias("s"))
    if model.metric == "macro_f1":
        pairs = predicted.select("_feature", truth.alias("label"), "prediction")
        return class_f1(pairs, "label", "prediction", ("_feature",)).groupBy("_feature").agg(F.avg("f1").alias("s"))
    classes = list(enumerate(model.labels)) if model.problem == "multiclass" else [(len(model.labels) - 1, model.labels[-1])]
    scored = F.array(*[F.struct(F.lit(i).alias("k"), F.get("probability", F.lit(i)).alias("p"), (truth == F.lit(c)).alias("hit")) for i, c in classes])
    long = predicted.select("_feature", F.explode(scored).alias("c")).select("_feature", F.concat_ws(":", "c.k", "_feature").alias("group"), "c.p", "c.hit")
    names = long.select("group", "_feature").distinct()
    return auc_by_group(long.drop("_feature"), "group", F.col("hit"), "p").join(F.broadcast(names), "group").groupBy("_feature").agg(F.avg("auc").alias("s"))


def model_metadata(model: TrainedModel, df: DataFrame) -> DataFrame:
    """One row about a model: target, metric, best candidate, leaderboard, strongest features."""
    top = sorted(model.importance.items(), key=lambda kv: -abs(kv[1]))[:TOP_FEATURES]
    row = (
        model.target,
        model.problem,
        model.metric,
        model.best,
        model.leaderboard[0][1],
        [(n, v) for n, v, _ in model.leaderboard],
        top,
        model.rows,
        len(model.features),
        model.seconds,
    )
    schema = (
        "target_column string, problem_type string, metric string, best_model string, score_val double, "
        "leaderboard array<struct<model:string,score_val:double>>, feature_importance array<struct<feature:string,importance:double>>, "
        "num_rows_trained long, num_features long, training_time_seconds double"
    )
    return df.sparkSession.createDataFrame([row], schema)
