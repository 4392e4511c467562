"""Text features as numbers, fitted on the training fold: slots follow the counted number of values.

Few values get a slot each, and one more for values never seen. Many values are told by the target: each value carries
the smoothed mean of the target over the training rows that have it, which takes one number (or one per class) however
many values there are. Training rows leave their own target out, so that a value seen once says nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.skew import skew_safe_lookup

# Columns with more values than this are told by the target; weight of the overall mean beside a value's own rows.
SLOTS, SMOOTHING = 64, 20.0


@dataclass
class CategoryEncoding:
    """What was learnt about text columns; ``width`` is the number of slots or means each gives the model."""

    slotted: list[str]
    told: list[str]
    cardinality: dict[str, int]
    classes: list[str]
    prior: list[float]
    slots: PipelineModel | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def outputs(self) -> list[str]:
        return [f"{c}_slots" for c in self.slotted] + [f"{c}_mean{j}" for c in self.told for j in range(len(self.prior))]

    @property
    def width(self) -> dict[str, int]:
        return {c: self.cardinality[c] + 1 for c in self.slotted} | {c: len(self.prior) for c in self.told}

    def transform(self, df: DataFrame, target: str | None = None) -> DataFrame:
        """Adds the outputs. With ``target``, for the training rows themselves, each row's own target is left out."""
        out = df if self.slots is None else self.slots.transform(df)
        for c in self.told:
            out = _looked_up(out, c, self.tables[c])
            own = [_measure(F.col(target), k) for k in self.classes or [None]] if target else [F.lit(0.0)] * len(self.prior)
            seen = F.coalesce(F.col("_stat.n"), F.lit(0)) - (1 if target else 0)
            for j, prior in enumerate(self.prior):
                total = F.coalesce(F.get("_stat.sums", F.lit(j)), F.lit(0.0)) - own[j]
                mean = (total + SMOOTHING * prior) / (seen + SMOOTHING)
                out = out.withColumn(f"{c}_mean{j}", F.when(F.col("_stat").isNull(), F.lit(prior)).otherwise(mean))
            out = out.drop("_stat")
        return out


def _looked_up(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """``_stat`` of the row's value: broadcast where the table is small, with heavy values apart otherwise."""
    return skew_safe_lookup(df, table, column, "_n", "_stat")


def _measure(target: Column, label: str | None) -> Column:
    """What is averaged: the target itself, or whether it is one class."""
    return target.cast("double") if label is None else (target.cast("string") == label).cast("double")


def fit_categories(train: DataFrame, columns: list[str], target: str, classes: list[str] | None = None, slots: int = SLOTS) -> CategoryEncoding:
    """Learn the encoding of text columns without nulls from training rows with a target.

    ``classes`` are the labels of a classification: of two the last is told, of more each; without, the target is a number.
    """
    told_classes = list(classes or [])
    told_classes = told_classes[-1:] if len(told_classes) == 2 else told_classes
    measures = [_measure(F.col(target), k) for k in told_classes or [None]]
    counted: dict[str, int] = {}
    if columns:
        values = train.select(*columns).unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        counted = {r["column"]: r["count"] for r in values.groupBy("column").count().collect()}
    few = [c for c in columns if counted.get(c, 0) <= slots]
    many = [c for c in columns if counted.get(c, 0) > slots]
    prior = [x or 0.0 for x in train.agg(*[F.avg(m).alias(f"p{i}") for i, m in enumerate(measures)]).first()] if many else [0.0] * len(measures)
    fitted = None
    if few:
        places = [f"{c}_place" for c in few]
        stages = [
            StringIndexer(inputCols=few, outputCols=places, handleInvalid="keep", stringOrderType="frequencyDesc"),
            OneHotEncoder(inputCols=places, outputCols=[f"{c}_slots" for c in few], dropLast=False),
        ]
        fitted = Pipeline(stages=stages).fit(train)
    tables = {}
    for c in many:
        grouped = train.groupBy(c).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(m).alias(f"_s{i}") for i, m in enumerate(measures)])
        stat = F.struct(F.col("_n").alias("n"), F.array(*[f"_s{i}" for i in range(len(measures))]).alias("sums"))
        tables[c] = grouped.select(c, "_n", stat.alias("_stat"))
    return CategoryEncoding(few, many, counted, told_classes, prior, fitted, tables)
