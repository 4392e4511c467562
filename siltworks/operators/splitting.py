"""Deterministic train / validation / test folds: exact class shares without sorting a class in one task.

A row's place is decided by the seeded digest of its key. Digests are uniform, so the digest at a given rank lies in a
narrow band around the rank's share of the digest range: one scan counts the classes, a second counts the rows below
each band and ranks the few rows inside it. The folds themselves are then a narrow comparison; no row is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions.hashing import hex_bits, seeded_md5
from siltworks.session import cut_lineage, pin_small

# Fold names and the shares at which they end.
CUTS = ((0.8, "train"), (0.9, "val"))
LAST_FOLD = "test"
SEED = 42
_PREFIX = 12
# Folds of tables above so many rows are dealt evenly, in so many partitions for each core.
EVEN_ROWS, PER_CORE = 1_000_000, 3


def drop_declared(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns that leak the outcome; a name that does not exist is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns to drop not found: {missing}")
    return df.drop(*columns)


def _cut_points(df: DataFrame, shares: tuple[float, ...], width: float = 6.0) -> DataFrame:
    """Per stratum and cut: the digest and key of the last row before the cut. ``df`` has _s, _d (digest), _k, _u (0..1)."""
    sizes = pin_small(df.groupBy("_s").agg(F.count(F.lit(1)).alias("n")))
    cuts = F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(p).alias("share")) for i, p in enumerate(shares)])
    band = F.lit(width) * F.sqrt(F.lit(0.25) / F.col("n"))
    wanted = (
        sizes.withColumn("c", F.explode(cuts))
        .select("_s", F.col("c.cut").alias("cut"), F.floor(F.col("c.share") * F.col("n")).alias("rank"), (F.col("c.share") - band).alias("low"), (F.col("c.share") + band).alias("high"))
        .where("rank > 0")
    )
    wanted = pin_small(wanted)
    spread = df.join(wanted, df["_s"].eqNullSafe(wanted["_s"])).drop(wanted["_s"]).where("_u <= high")
    below = spread.groupBy("_s", "cut").agg(F.count_if(F.col("_u") < F.col("low")).alias("below"), F.count(F.lit(1)).alias("upto"), F.first("rank").alias("rank"))
    below = pin_small(below)
    if not below.where("rank <= below or rank > upto").isEmpty():
        return _cut_points(df, shares, width * 4)
    inside = spread.where("_u >= low").drop("rank")
    ranked = inside.withColumn("r", F.row_number().over(W.partitionBy("_s", "cut").orderBy("_d", "_k")))
    left, right = ranked.alias("a"), below.alias("b")
    hit = (F.col("a._s").eqNullSafe(F.col("b._s"))) & (F.col("a.cut") == F.col("b.cut")) & (F.col("a.r") + F.col("b.below") == F.col("b.rank"))
    return left.join(right, hit).select("a._s", "a.cut", "a._d", "a._k")


def assign_folds(df: DataFrame, key: str, target: str | None = None, seed: int = SEED, out: str = "fold") -> DataFrame:
    """Adds the fold. With a target the shares hold inside every class; without, over the whole table."""
    shares = tuple(share for share, _ in CUTS)
    digest = seeded_md5(F.col(f"`{key}`"), seed)
    stratum = F.col(f"`{target}`") if target else F.lit(0)
    keyed = df.select(stratum.alias("_s"), digest.alias("_d"), F.col(f"`{key}`").alias("_k"))
    keyed = keyed.withColumn("_u", hex_bits(F.col("_d"), 1, _PREFIX) / F.lit(float(16**_PREFIX)))
    points = _cut_points(keyed, shares)
    wide = points.groupBy("_s").agg(*[F.max(F.when(F.col("cut") == i, F.struct("_d", "_k"))).alias(f"_c{i}") for i in range(len(shares))])
    wide = pin_small(wide)
    marked = df.withColumns({"_row_s": stratum, "_row_p": F.struct(digest.alias("_d"), F.col(f"`{key}`").alias("_k"))})
    joined = marked.join(wide, F.col("_row_s").eqNullSafe(F.col("_s")), "left")
    fold = F.lit(LAST_FOLD)
    for i, (_, name) in reversed(list(enumerate(CUTS))):
        fold = F.when(F.col("_row_p") <= F.col(f"_c{i}"), name).otherwise(fold)
    return joined.withColumn(out, fold).drop("_row_s", "_row_p", "_s", *[f"_c{i}" for i in range(len(shares))])


def three_way_split(df: DataFrame, key: str, target: str | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test frames, disjoint and together complete."""
    folds = assign_folds(df, key, target, seed, "_fold")
    return tuple(folds.where(F.col("_fold") == name).drop("_fold") for name in (*[n for _, n in CUTS], LAST_FOLD))


def written_folds(df: DataFrame, key: str, target: str | None = None, seed: int = SEED) -> list[DataFrame]:
    """The three folds, each written once; a large table's rows are dealt evenly over the cores, however few or uneven its files are.

    Every pass over a fold, and there are hundreds while models are fitted, has the partitions that it was written in.
    """
    folds = three_way_split(df, key, target, seed)
    if df.agg(F.count(F.lit(1))).first()[0] > EVEN_ROWS:
        partitions = PER_CORE * df.sparkSession.sparkContext.defaultParallelism
        folds = [f.repartition(partitions) for f in folds]
    return [cut_lineage(f) for f in folds]


def schema_drift(reference: DataFrame, fold: DataFrame) -> tuple[list[str], list[str]]:
    """Columns a fold has too many and too few, compared with the training fold."""
    extra = [c for c in fold.columns if c not in reference.columns]
    missing = [c for c in reference.columns if c not in fold.columns]
    return extra, missing


def check_schema_drift(reference: DataFrame, fold: DataFrame, name: str = "fold") -> None:
    extra, missing = schema_drift(reference, fold)
    if extra or missing:
        raise ValueError(f"schema drift in {name}: extra={extra} missing={missing}")
