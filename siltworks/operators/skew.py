"""Keeping hot groups out of single tasks: salted lookups and sliced windows.

A third of all rows may share one key. Aggregates are safe (each task sends partial results); a join or a window on
that key is not. The helpers here split only the hot groups and leave the others alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.session import BROADCAST_ROWS, cut_lineage, pin_small

# A group up to this size sorts well inside one task; a larger one is cut into slices.
HOT_ROWS = 5_000_000
MAX_SLICES = 1024
HOT_KEYS, KEY_BYTES = 1_000, 64 * 1024


def skew_safe_lookup(df: DataFrame, lookup: DataFrame, key: str, weight: str, value: str, salts: int = 512, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` left-joined to ``lookup`` (one row per key, ``weight`` = how many rows of ``df`` have the key).

    A lookup counted to be small is broadcast. Otherwise it is written once, its few heaviest keys are broadcast, and
    only the remaining rows are shuffled; rows already answered (and null keys) are spread over salts that match nothing.
    """
    pinned = pin_small(lookup, limit)
    if pinned is not lookup:
        return df.join(pinned.select(key, value), key, "left")
    lookup = cut_lineage(lookup)
    # A thousand keys of at most 64 KB each, the value counted in: what is gathered stays below 64 MB.
    size = F.octet_length(F.to_json(F.struct(F.col(f"`{key}`"), F.col(f"`{value}`"))))
    short = F.col(f"`{key}`").isNotNull() & (size <= KEY_BYTES)
    heavy = lookup.where(short).select(key, weight, value).orderBy(F.desc(weight), key).limit(HOT_KEYS)
    heavy_rows = df.sparkSession.createDataFrame(heavy.collect(), heavy.schema)
    marked = df.join(F.broadcast(heavy_rows.select(key, F.col(value).alias("_hot"))), key, "left")
    answered = F.col("_hot").isNotNull() | F.col(f"`{key}`").isNull()
    salted = marked.withColumn("_salt", F.when(answered, 1 + F.pmod(F.xxhash64(*_hashable(df)), F.lit(salts))).otherwise(F.lit(0)))
    cold = lookup.select(key, F.col(value).alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    joined = salted.join(cold, [key, "_salt"], "left")
    return joined.withColumn(value, F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_salt")


def _hashable(df: DataFrame) -> list[str]:
    return [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


def slice_hot_groups(df: DataFrame, keys: list[str], order: Column, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """Adds ``_slice`` and says whether any group was hot.

    Ordinary groups are one slice, 0. At most rows / ``hot_rows`` groups can be hot, which bounds what is gathered here. Groups above ``hot_rows`` are cut into consecutive ranges of the numeric ``order``;
    the ranges come from a quantile sketch and are pinned before use, so that every evaluation agrees.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = sizes.collect()
    if not hot:
        return df.withColumn("_slice", F.lit(0)), False
    spark = df.sparkSession
    hot_frame = F.broadcast(spark.createDataFrame(hot, sizes.schema))
    grid = [i / MAX_SLICES for i in range(1, MAX_SLICES)]
    step = F.greatest(F.lit(1), F.floor(F.lit(MAX_SLICES) / F.ceil(F.col("_n") / F.lit(hot_rows)))).cast("int")
    sketch = (
        df.withColumn("_o", order)
        .join(hot_frame.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx("_o", grid, MAX_SLICES * 10).alias("_grid"))
        .join(hot_frame, keys)
        .withColumn("_step", step)
        .select(*keys, F.array_distinct(F.filter("_grid", lambda v, i: (i + 1) % F.col("_step") == 0)).alias("_bounds"))
    )
    pinned = F.broadcast(spark.createDataFrame(sketch.collect(), sketch.schema))
    sliced = df.withColumn("_o", order).join(pinned, keys, "left")
    number = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col("_o"))), F.lit(0))
    return sliced.withColumn("_slice", number).drop("_bounds", "_o"), True


def slice_carry(sliced: DataFrame, keys: list[str], aggregates: dict[str, Column], carry: dict[str, Column], after: bool = False) -> DataFrame:
    """Values carried into each slice from the slices before it (or, with ``after``, from those behind it).

    The frame below the window holds one row per group and slice, a few per hot group.
    """
    per_slice = sliced.groupBy(*keys, "_slice").agg(*[a.alias(n) for n, a in aggregates.items()])
    w = W.partitionBy(*keys).orderBy("_slice")
    w = w.rowsBetween(1, W.unboundedFollowing) if after else w.rowsBetween(W.unboundedPreceding, -1)
    carried = per_slice.select(*keys, "_slice", *[c.over(w).alias(n) for n, c in carry.items()])
    some = F.lit(False)
    for n in carry:
        some = some | F.col(n).isNotNull()
    return pin_small(carried.where(some))


def row_numbers(df: DataFrame, keys: list[str], order: list, out: str, position: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based row number per group; a hot group is numbered slice by slice, plus the rows of the slices before.

    ``position`` is numeric and grows with the first ordering column; it is what slices are cut by.
    """
    sliced, hot = slice_hot_groups(df, keys, position, hot_rows)
    numbered = sliced.withColumn(out, F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)).cast("long"))
    if not hot:
        return numbered.drop("_slice")
    offsets = slice_carry(sliced, keys, {"_n": F.count(F.lit(1))}, {"_before": F.sum("_n")})
    joined = numbered.join(offsets, [*keys, "_slice"], "left")
    return joined.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_slice", "_before")


def neighbour(df: DataFrame, keys: list[str], order: list[str], position: Column, value: Column, out: str, ahead: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The value of the next (or previous) row of the group; across slice borders it is carried from the next slice.

    ``order`` columns must identify a row within its group; ``position`` is numeric and grows with the first of them.
    """
    sliced, hot = slice_hot_groups(df, keys, position, hot_rows)
    here = F.struct(*[F.col(c) for c in order], value.alias("_v"))
    w = W.partitionBy(*keys, "_slice").orderBy(*order)
    moved = sliced.withColumn("_next", (F.lead if ahead else F.lag)(here, 1).over(w))
    if not hot:
        return moved.withColumn(out, F.col("_next._v")).drop("_next", "_slice")
    pick = F.min if ahead else F.max
    carried = slice_carry(sliced, keys, {"_edge": pick(here)}, {"_carry": pick("_edge")}, after=ahead)
    joined = moved.join(carried, [*keys, "_slice"], "left")
    return joined.withColumn(out, F.coalesce("_next", "_carry")["_v"]).drop("_next", "_carry", "_slice")


def running_before(df: DataFrame, keys: list[str], order: list[str], position: Column, values: dict[str, tuple[str, Column]], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running aggregates over the rows before each row of its group: ``values`` maps a name to (``sum``|``max``, column)."""
    sliced, hot = slice_hot_groups(df, keys, position, hot_rows)
    fold = {"sum": F.sum, "max": F.max}
    w = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = sliced.withColumns({n: fold[kind](c).over(w) for n, (kind, c) in values.items()})
    if not hot:
        return out.drop("_slice")
    totals = {f"_t_{n}": fold[kind](c) for n, (kind, c) in values.items()}
    carry = {f"_c_{n}": fold[kind](f"_t_{n}") for n, (kind, _) in values.items()}
    out = out.join(slice_carry(sliced, keys, totals, carry), [*keys, "_slice"], "left")
    both = {
        n: (
            F.when(F.col(n).isNull() & F.col(f"_c_{n}").isNull(), F.lit(None)).otherwise(F.coalesce(n, F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)))
            if kind == "sum"
            else F.coalesce(n, f"_c_{n}")
        )
        for n, (kind, _) in values.items()
    }
    return out.withColumns(both).drop("_slice", *carry)
