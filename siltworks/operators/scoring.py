"""Held-out metrics as exact aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.operators.skew import HOT_ROWS, slice_carry, slice_hot_groups

METRICS = ("roc_auc", "macro_f1", "accuracy", "rmse")


def auc_by_group(df: DataFrame, group: str, positive: Column, score: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(group, auc)``: exact area under the ROC curve, ties counted half.

    Rows collapse to distinct scores first. The running count of negatives below a score is a window over those, cut
    into slices where there are too many distinct scores for one task.
    """
    points = df.groupBy(group, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    sliced, hot = slice_hot_groups(points, [group], F.col(score), hot_rows)
    w = W.partitionBy(group, "_slice").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    running = sliced.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    if hot:
        carried = slice_carry(sliced, [group], {"_neg": F.sum("neg")}, {"_before": F.sum("_neg")})
        running = running.join(carried, [group, "_slice"], "left").withColumn("below", F.col("below") + F.coalesce("_before", F.lit(0)))
    wins = F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return running.groupBy(group).agg((wins / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def roc_auc(df: DataFrame, label: str, score: str, positive: object = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row: binary AUC of ``score`` for the positive label."""
    one = df.select(F.lit(0).alias("_g"), F.col(label), F.col(score)).where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return auc_by_group(one, "_g", F.col(label) == F.lit(positive), score, hot_rows).select(F.col("auc").alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, label: str, scores: dict[object, str]) -> DataFrame:
    """One row: macro mean of the one-vs-rest AUC over the classes; ``scores`` names each class's score column."""
    pairs = F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).cast("double").alias("score"), (F.col(label) == F.lit(k)).alias("hit")) for k, c in scores.items()])
    long = df.select(F.explode(pairs).alias("p")).select("p.class", "p.score", "p.hit")
    return auc_by_group(long, "class", F.col("hit"), "score").agg(F.avg("auc").alias("roc_auc"))


def class_f1(df: DataFrame, label: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``(class, tp, fp, fn, f1)`` over every class that occurs as a label or a prediction, per group of ``by``."""
    confusion = df.groupBy(*by, F.col(label).cast("string").alias("l"), F.col(prediction).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = confusion.select(
        *by,
        F.explode(
            F.when(F.col("l") == F.col("p"), F.array(_side("l", "tp"))).otherwise(F.array(_side("l", "fn"), _side("p", "fp")))
        ).alias("s"),
        "n",
    ).select(*by, "s.class", "s.kind", "n")
    counts = sides.groupBy(*by, "class").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("tp", "fp", "fn")])
    return counts.withColumn("f1", 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def _side(column: str, kind: str) -> Column:
    return F.struct(F.col(column).alias("class"), F.lit(kind).alias("kind"))


def macro_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return class_f1(df, label, prediction).agg(F.avg("f1").alias("macro_f1"))


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def rmse(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col(prediction), F.lit(2)))).alias("rmse"))
