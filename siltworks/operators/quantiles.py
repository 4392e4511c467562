"""Exact quantiles with linear interpolation, for all columns and ranks together, in a fixed number of scans.

1. One scan builds a mergeable KLL sketch per column; it brackets the wanted ranks.
2. Where a bracket may still hold many rows, one more scan sketches its inside and narrows it.
3. One counting scan: rows outside every bracket fold to one count per gap, rows inside to one per different value.

The values at the ranks are then read off a running count over what is left, so the answer does not depend on the
sketches. A bracket that missed its rank, which a sketch may do, is known from the counts and made wider.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Sketch size, and the share of rows by which its ranks are trusted on either side.
SKETCH_SIZE, SKETCH_SLACK = 4096, 0.004
# Points at which the inside of a bracket is read off its sketch.
GRID = 256
# Brackets of all columns are narrowed until they hold at most about so many rows each.
INSIDE_ROWS = 1_000_000
INF = float("inf")


@dataclass(frozen=True)
class Bracket:
    """A closed interval of values that should hold the ranks ``first`` to ``last`` of a column."""

    column: int
    low: float
    high: float
    first: int
    last: int
    rows: float


def exact_quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probabilities: tuple[float, ...] = (0.25, 0.5, 0.75),
    inside_rows: int = INSIDE_ROWS,
    sketch_size: int = SKETCH_SIZE,
    slack: float = SKETCH_SLACK,
) -> dict[str, list[float | None]]:
    """For each named double expression the quantiles at the given probabilities (null when it has no value).

    Expressions are null where a row has no value; NaN and infinities are the caller's to leave out.
    """
    if not values or not probabilities:
        return {n: [] for n in values}
    names = list(values)
    pairs = _long(df, list(values.values()))
    counts, brackets = _first_brackets(pairs, len(names), probabilities, sketch_size, slack)
    while any(b.rows > inside_rows for b in brackets):
        narrowed = _narrowed(pairs, brackets, sketch_size, slack)
        if sum(b.rows for b in narrowed) > 0.5 * sum(b.rows for b in brackets):
            # Heavy values fill the brackets: they fold to one row each in the last scan, whatever their number.
            brackets = narrowed
            break
        brackets = narrowed
    found: dict[tuple[int, int], float] = {}
    while brackets:
        got = _values_at_ranks(pairs, brackets)
        found |= got
        brackets = [_wider(b) for b in brackets if any((b.column, r) not in found for r in (b.first, b.last))]
    return {n: [_interpolate(found, i, p, counts.get(i, 0)) for p in probabilities] for i, n in enumerate(names)}


def sketch_quantiles(df: DataFrame, values: dict[str, Column], probabilities: tuple[float, ...], sketch_size: int = SKETCH_SIZE) -> dict[str, list[float | None]]:
    """Quantiles read off one KLL sketch per column: one scan, within a small share of rows of the exact ranks."""
    if not values or not probabilities:
        return {n: [] for n in values}
    pairs = _long(df, list(values.values()))
    sketched = pairs.groupBy("c").agg(F.kll_sketch_agg_double("v", sketch_size).alias("s"))
    rows = sketched.select("c", F.kll_sketch_get_quantile_double("s", F.lit(list(probabilities)).cast("array<double>")).alias("q")).collect()
    found = {r["c"]: list(r["q"]) for r in rows}
    return {n: found.get(i, [None] * len(probabilities)) for i, n in enumerate(values)}


def _long(df: DataFrame, columns: list[Column]) -> DataFrame:
    """(c, v): column number and value of every row that has one, zeros without a sign."""
    narrow = df.select(*[(x.cast("double") + F.lit(0.0)).alias(str(i)) for i, x in enumerate(columns)])
    pairs = narrow.unpivot([], narrow.columns, "c", "v").where("v is not null")
    return pairs.select(F.col("c").cast("int").alias("c"), "v")


def _rank_pair(p: float, total: int) -> tuple[int, int, float]:
    position = p * (total - 1)
    low = min(math.floor(position), total - 1)
    return low, min(low + 1, total - 1), position - low


def _interpolate(found: dict[tuple[int, int], float], column: int, p: float, total: int) -> float | None:
    if not total:
        return None
    low, high, weight = _rank_pair(p, total)
    return found[column, low] + (found[column, high] - found[column, low]) * weight


def _first_brackets(pairs: DataFrame, columns: int, probabilities: tuple[float, ...], size: int, slack: float) -> tuple[dict[int, int], list[Bracket]]:
    sketched = pairs.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", size).alias("s"))
    shares = [share for p in probabilities for share in (max(p - slack, 0.0), min(p + slack, 1.0))]
    rows = sketched.select("c", "n", F.kll_sketch_get_quantile_double("s", F.lit(shares).cast("array<double>")).alias("q")).collect()
    brackets = []
    for r in rows:
        for j, p in enumerate(probabilities):
            first, last, _ = _rank_pair(p, r["n"])
            low = -INF if p - slack <= 0 else r["q"][2 * j]
            high = INF if p + slack >= 1 else r["q"][2 * j + 1]
            brackets.append(Bracket(r["c"], low, high, first, last, min(1.0, 2 * slack) * r["n"]))
    return {r["c"]: r["n"] for r in rows}, _in_order(brackets)


def _in_order(brackets: list[Bracket]) -> list[Bracket]:
    return sorted(dict.fromkeys(brackets), key=lambda b: (b.column, b.low, b.high, b.first))


def _ends(brackets: list[Bracket]) -> dict[int, list[tuple[float, int]]]:
    """Per column the sorted borders of its gaps and insides: (value, 0) opens before the value, (value, 1) after it."""
    out: dict[int, set[tuple[float, int]]] = {}
    for b in brackets:
        out.setdefault(b.column, set()).update(((b.low, 0), (b.high, 1)))
    return {c: sorted(e) for c, e in out.items()}


def _cells(pairs: DataFrame, brackets: list[Bracket]) -> tuple[DataFrame, dict[int, list[tuple[float, int]]]]:
    """Pairs with the number ``cell`` of borders at or below the value and whether it lies ``inside`` any bracket.

    The borders are a frame of one row per column, a few numbers each.
    """
    ends = _ends(brackets)
    spark = pairs.sparkSession
    width = max(len(e) for e in ends.values())
    rows = []
    for c, e in ends.items():
        inside = [any((b.low, 0) <= e[i - 1] and e[i - 1] < (b.high, 1) for b in brackets if b.column == c) for i in range(1, len(e) + 1)]
        padded = e + [(None, 0)] * (width - len(e))
        rows.append((c, [x for x, _ in padded], [bool(a) for _, a in padded], [False, *inside]))
    table = spark.createDataFrame(rows, "c int, e array<double>, after array<boolean>, hit array<boolean>")
    joined = pairs.join(F.broadcast(table), "c")
    cell = F.lit(0)
    for i in range(width):
        border, v = F.get("e", F.lit(i)), F.col("v")
        cell = cell + F.when((v > border) | ((v == border) & ~F.get("after", F.lit(i))), 1).otherwise(0)
    celled = joined.select("c", "v", cell.alias("cell"), "hit")
    return celled.select("c", "v", "cell", F.get("hit", F.col("cell")).alias("inside")), ends


def _narrowed(pairs: DataFrame, brackets: list[Bracket], size: int, slack: float) -> list[Bracket]:
    """Sketch the inside of each bracket, beside exact counts of what lies below it, and take narrower ones."""
    celled, ends = _cells(pairs, brackets)
    sketched = celled.groupBy("c", "cell").agg(F.count(F.lit(1)).alias("n"), F.first("inside").alias("inside"), F.kll_sketch_agg_double(F.when(F.col("inside"), F.col("v")), size).alias("s"))
    grid = F.lit([i / GRID for i in range(GRID + 1)]).cast("array<double>")
    rows = sketched.select("c", "cell", "n", F.when(F.col("inside"), F.kll_sketch_get_quantile_double("s", grid)).alias("q")).collect()
    cells = {(r["c"], r["cell"]): (r["n"], r["q"]) for r in rows}
    out = []
    for b in brackets:
        e = ends[b.column]
        own, below, kept = range(e.index((b.low, 0)) + 1, e.index((b.high, 1)) + 1), 0, []
        for i in range(own.stop):
            n, q = cells.get((b.column, i), (0, None))
            first, last = max(b.first, below), min(b.last, below + n - 1)
            if i in own and n and first <= last:
                a = math.floor(((first - below) / n - slack) * GRID) - 1
                z = math.ceil(((last - below + 1) / n + slack) * GRID) + 1
                low, high = e[i - 1][0] if a <= 0 else q[a], e[i][0] if z >= GRID else q[z]
                kept.append(Bracket(b.column, low, high, first, last, 0.0 if low == high else n * min(1.0, (z - a) / GRID)))
            below += n
        out += kept if sum(k.last - k.first + 1 for k in kept) == b.last - b.first + 1 else [_wider(b)]
    return _in_order(out)


def _wider(b: Bracket) -> Bracket:
    """After a miss: the whole column, which cannot miss."""
    return Bracket(b.column, -INF, INF, b.first, b.last, 0.0)


def _values_at_ranks(pairs: DataFrame, brackets: list[Bracket]) -> dict[tuple[int, int], float]:
    """The values at the brackets' ranks, where they lie inside: one scan, one shuffle of the different values inside."""
    celled, _ = _cells(pairs, brackets)
    folded = celled.groupBy("c", "cell", F.when(F.col("inside"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    within = folded.withColumn("upto", F.sum("n").over(W.partitionBy("c", "cell").orderBy("v")))
    cells = folded.groupBy("c", "cell").agg(F.sum("n").alias("whole"))
    before = cells.select("c", "cell", (F.sum("whole").over(W.partitionBy("c").orderBy("cell")) - F.col("whole")).alias("below"))
    ranks: dict[int, set[int]] = {}
    for b in brackets:
        ranks.setdefault(b.column, set()).update((b.first, b.last))
    wanted = pairs.sparkSession.createDataFrame([(c, sorted(r)) for c, r in ranks.items()], "c int, ranks array<long>")
    # Both frames have a few rows per column: a cell lies between two borders, ranks are asked for by the caller.
    placed = within.where("v is not null").join(F.broadcast(before), ["c", "cell"]).join(F.broadcast(wanted), "c")
    upto = F.col("below") + F.col("upto")
    hits = F.filter("ranks", lambda r: (r >= upto - F.col("n")) & (r < upto))
    return {(r["c"], r["rank"]): r["v"] for r in placed.select("c", "v", F.explode(hits).alias("rank")).collect()}
