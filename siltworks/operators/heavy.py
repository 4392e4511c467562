"""Frequent values without shuffling every value: sketched candidates, then one exact recount of the candidates.

Each task keeps a bounded table of the values it saw most (a mergeable frequent-items sketch per column); the merged tables
name the candidates. A second scan counts just those, so what crosses the network is a row per candidate and task. The
sketch bounds the count of whatever it does not name: where the k-th exact count exceeds that bound, the top k are proven.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.operators.frequency import restore_long_values, top_per_column, typed_pairs

# Values a sketch tracks per column and task, and the candidates it names; its error is at most ERROR / TRACKED of the rows.
TRACKED, CANDIDATES, ERROR = 4096, 256, 3.5


def counted_candidates(pairs: DataFrame, tracked: int = TRACKED, candidates: int = CANDIDATES) -> DataFrame:
    """``(column, value, n, bound)`` of the candidates: exact counts, and the most that any other value of the column can have."""
    candidates = min(candidates, tracked)
    sketched = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(value, {candidates}, {tracked})").alias("found"))
    # Estimates may be off by the error either way; a full list says that a value left out has no larger estimate than the last.
    error = F.col("rows") * F.lit(ERROR / tracked)
    last = F.when(F.size("found") >= candidates, F.element_at("found", -1)["count"]).otherwise(F.lit(0))
    named = sketched.select("column", "rows", (last + error).alias("reach"), F.explode("found").alias("f")).select("column", F.col("f.item").alias("value"), "rows", "reach")
    # At most so many candidates per column, whatever the table: a broadcast of that size.
    hits = pairs.join(F.broadcast(named), ["column", "value"])
    counted = hits.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.first("rows").alias("rows"), F.first("reach").alias("reach"))
    # Nor can a value have more rows than the candidates leave over.
    rest = F.col("rows") - F.sum("n").over(W.partitionBy("column"))
    return counted.select("column", "value", "n", F.least(F.col("reach"), rest.cast("double")).alias("bound"))


def heavy_top(pairs: DataFrame, k: int, tracked: int = TRACKED, candidates: int = CANDIDATES) -> DataFrame:
    """``(column, rank, value, n, proven)``: the top candidates of each column; ``proven`` where no other value can be among them."""
    top = top_per_column(counted_candidates(pairs, tracked, max(candidates, k)), k)
    column = W.partitionBy("column")
    proven = F.when(F.count(F.lit(1)).over(column) < k, F.col("bound") < 1).otherwise(F.min("n").over(column) > F.col("bound"))
    return top.select("column", "rank", "value", "n", proven.alias("proven"))


def top_values_by_recount(df: DataFrame, columns: list[str] | None = None, k: int = 5, exact: bool = True, tracked: int = TRACKED) -> DataFrame:
    """``(column, rank, value, n)``: the most frequent whole values of each column, ties by value.

    With ``exact`` the columns whose top the sketch cannot prove (all values about equally rare) are counted in full, and only
    those; without, the best candidates are returned with their exact counts.
    """
    out = None
    for kind, (names, pairs) in typed_pairs(df, columns).items():
        top = heavy_top(pairs, k, tracked)
        if exact:
            # A few rows per column: what the scan found is kept, so that it is not repeated.
            rows = top.collect()
            settled = {r["column"] for r in rows if r["proven"]}
            unproven = [c for c in names if c not in settled]
            top = df.sparkSession.createDataFrame([r for r in rows if r["column"] in settled], top.schema).drop("proven")
            if unproven:
                rest = pairs.where(F.col("column").isin(unproven)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
                top = top.unionByName(top_per_column(rest, k).select("column", "rank", "value", "n"))
        top = top.select("column", "rank", F.col("value").cast("string").alias("value"), "n")
        top = restore_long_values(df, top) if kind == "text" else top
        one = top.select("column", "rank", "value", "n")
        out = one if out is None else out.unionByName(one)
    return out
