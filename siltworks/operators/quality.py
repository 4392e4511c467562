"""Quality scores from a profile: small aggregates over one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.inference import NUMERIC

# Weights and penalties of the scores.
TARGET_WEIGHT, PLAUSIBILITY_WEIGHT, STRUCTURE_WEIGHT = 0.45, 0.30, 0.25
PLAUSIBILITY_ALONE, STRUCTURE_ALONE = 0.55, 0.45
SENTINEL_PENALTY, HEAPING_PENALTY, TARGET_HEAPING_PENALTY, TARGET_DEFECT_PENALTY = 0.7, 0.4, 0.7, 0.5
HEAPING, SENTINEL = "Value Heaping", "Possible Sentinel"


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _score(c: Column) -> Column:
    """Three decimals; summation noise is rounded away first, so that halves do not depend on the order of addition."""
    return F.round(F.round(c, 9), 3)


def plausibility() -> Column:
    """Product of the penalties of a row's warnings in order; heaping ends the product."""
    start = F.struct(F.lit(1.0).alias("score"), F.lit(False).alias("done"))

    def fold(acc: Column, w: Column) -> Column:
        factor = F.when(w.contains(HEAPING), HEAPING_PENALTY).when(w.contains(SENTINEL), SENTINEL_PENALTY).otherwise(1.0)
        return F.when(acc["done"], acc).otherwise(F.struct((acc["score"] * factor).alias("score"), w.contains(HEAPING).alias("done")))

    return F.aggregate("warnings", start, fold, lambda acc: acc["score"])


def base_metrics(profile_rows: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """One row: mean completeness, share of numeric columns without inf or failed values, and the columns at fault."""
    numeric = F.col("inferred_type") == NUMERIC
    dirty = numeric & (F.coalesce("inf_nan_count", F.lit(0)) > 0)
    return profile_rows.agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.max("row_count").alias("row_count"),
        F.coalesce(F.avg("completeness"), F.lit(0.0)).alias("completeness"),
        F.coalesce(F.count_if(numeric & ~dirty) / F.nullif(F.count_if(numeric), F.lit(0)), F.lit(1.0)).alias("structural_integrity"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(dirty, F.struct("position", "column")))), lambda s: s["column"]), ", "
        ).alias("dirty_columns"),
        F.coalesce(F.avg(F.when(numeric, plausibility())), F.lit(1.0)).alias("value_plausibility"),
        F.transform(
            F.array_sort(F.collect_list(F.when(numeric & F.exists("warnings", lambda w: w.contains(HEAPING)), F.struct("position", "column")))),
            lambda s: F.concat(F.lit("heaping: "), s["column"]),
        ).alias("heaping_flags"),
        *(extra or []),
    )


def _with_target(profile_rows: DataFrame, target: str | None) -> DataFrame:
    """The base metrics beside the target's own numbers, in one aggregate."""
    hit = F.col("column") == F.lit(target)
    own = [
        F.count_if(hit).alias("target_found"),
        F.max(F.when(hit, F.col("completeness"))).alias("target_completeness"),
        F.max(F.when(hit, F.coalesce("inf_nan_count", F.lit(0)))).alias("target_inf_nan"),
        F.max(F.when(hit, F.exists("warnings", lambda w: w.contains(HEAPING)))).alias("target_heaped"),
    ]
    return base_metrics(profile_rows, own)


def _flags(target: str | None) -> list[Column]:
    dirty = F.when(F.col("dirty_columns") != "", F.concat(F.lit("inf_nan_present: "), F.col("dirty_columns")))
    if target is None:
        return [dirty]
    return [
        dirty,
        F.when(F.col("target_inf_nan") > 0, F.concat(F.lit(f"target_inf_nan: {target} has "), F.col("target_inf_nan").cast("string"), F.lit(" inf/nan values"))),
        F.when(F.col("target_found") == 0, F.lit(f"target_column_not_found: {target}")),
    ]


def _defect_share() -> Column:
    share = F.coalesce(F.col("target_inf_nan"), F.lit(0)) / F.nullif(F.col("row_count"), F.lit(0))
    return F.coalesce(F.when(share > 1, F.lit(1.0)).otherwise(share), F.lit(0.0))


def structural_score(profile_rows: DataFrame, target: str | None = None) -> DataFrame:
    """One row: structural score, completeness, flags."""
    base = _with_target(profile_rows, target)
    share = _defect_share()
    score = F.col("structural_integrity") * (1.0 - TARGET_DEFECT_PENALTY * share)
    empty = F.col("n_columns") == 0
    return base.select(
        F.when(empty, 0.0).otherwise(_score(_clip(score))).alias("structural_score"),
        _score(F.col("completeness")).alias("completeness"),
        F.when(empty, "no_columns_in_profile").otherwise(F.array_join(F.array_compact(F.array(*_flags(target))), "; ")).alias("flags"),
    )


def quality_score(profile_rows: DataFrame, target: str | None = None) -> DataFrame:
    """One row: overall score, its parts, and flags."""
    base = _with_target(profile_rows, target)
    share = _defect_share()
    heaped = F.coalesce("target_heaped", F.lit(False))
    integrity = F.when(
        F.col("target_found") > 0,
        F.col("target_completeness") * (1.0 - share) * F.when(heaped, TARGET_HEAPING_PENALTY).otherwise(1.0),
    )
    overall = F.when(
        F.col("ti").isNotNull(),
        TARGET_WEIGHT * F.col("ti") + PLAUSIBILITY_WEIGHT * F.col("value_plausibility") + STRUCTURE_WEIGHT * F.col("structural_integrity"),
    ).otherwise(PLAUSIBILITY_ALONE * F.col("value_plausibility") + STRUCTURE_ALONE * F.col("structural_integrity"))
    target_heaping = F.when(heaped, F.lit(f"target_heaping: {target}"))
    flags = F.concat(F.array_compact(F.array(*_flags(target), target_heaping)), F.col("heaping_flags"))
    empty = F.col("n_columns") == 0
    return base.withColumn("ti", integrity).select(
        F.when(empty, 0.0).otherwise(_score(_clip(overall))).alias("overall"),
        _score(F.col("completeness")).alias("completeness"),
        _score(F.col("ti")).alias("target_integrity"),
        F.when(empty, 0.0).otherwise(_score(F.col("value_plausibility"))).alias("value_plausibility"),
        F.when(empty, 0.0).otherwise(_score(F.col("structural_integrity"))).alias("structural_integrity"),
        F.when(empty, "no_columns_in_profile").otherwise(F.array_join(flags, "; ")).alias("flags"),
    )
