"""How quality filters interact: for each part and each order of the filters, what every step removes and what it repeats.

A document's five verdicts put it into one cell of a 2x2x2x2x2 table. One aggregate counts the cells of every part; all
figures of all orders are contractions of that table with *pass*, *fail* or *all* along each axis.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.llm.frames import UPPER, text_of, written

FILTERS = "ABCDE"
# Fixed values of the filters: fewest words, least per cent of distinct words, most per cent of capitals, marks that disqualify.
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
REPORT = T.StructType(
    [T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())]
    + [T.StructField(name, T.LongType()) for name in FIGURES]
)
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
# Parts of one batch that Python hands back; each gives 600 rows.
PARTS = 32


def bit(letter: str) -> int:
    """Axes run in the order of the letters, so the first filter is the highest bit."""
    return 1 << (len(FILTERS) - 1 - FILTERS.index(letter))


def text_failures(text: Column) -> Column:
    """The bits of the filters that look at the text alone, for a text that is not null."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct, points = F.size(words), F.size(F.array_distinct(words)), F.length(text)
    capitals = points - F.length(F.translate(text, UPPER, ""))
    failed = {
        "A": n < FEWEST_WORDS,
        "B": distinct.cast("long") * 100 < n.cast("long") * DISTINCT_PERCENT,
        "C": capitals.cast("long") * 100 > points.cast("long") * CAPITAL_PERCENT,
        "D": text.rlike(MARKS),
    }
    return reduce(lambda a, b: a + b, [F.when(c, bit(k)).otherwise(0) for k, c in failed.items()])


def verdict_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Equal documents of a part folded to one row: id, part, fails (bits A to D), mark of the text, n, and whether labelled good or toxic."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text")
    )
    rows = rows.select("id", "part", text_failures(F.col("text")).alias("fails"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("mark"))
    rows = rows.groupBy("id", "mark", "part", "fails").agg(F.count(F.lit(1)).alias("n"))

    def any_one(name: str) -> Column:
        return F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0)).alias(name)

    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(any_one("quality"), any_one("toxic"))
    # Rows without an identifier have no label: they stay out of the join, where they would meet in one task.
    named = rows.where("id is not null").join(told, "id", "left")
    known = named.select("id", "mark", "part", "fails", "n", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return known.unionByName(rows.where("id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def cell_counts(rows: DataFrame) -> DataFrame:
    """``(part, cell, n, good, toxic)`` over the rows of ``verdict_rows``, read twice: at most 32 rows for each part.

    The repeats filter needs no look at a group of copies as a whole: a text's smallest identifier is an aggregate, and
    only the rows that carry it (looked up by text and identifier together) move from *fail* to *pass*.
    """
    first = rows.groupBy("mark").agg(F.min("id").alias("id"))
    passing = rows.join(first, ["mark", "id"], "left_semi").unionByName(rows.where("id is null"), allowMissingColumns=True)
    repeats = bit("E")

    def cells(frame: DataFrame, cell: Column, sign: int) -> DataFrame:
        return frame.select("part", cell.alias("cell"), (F.col("n") * sign).alias("n"), "good", "toxic")

    moved = cells(rows, F.col("fails") + repeats, 1).unionByName(cells(passing, F.col("fails") + repeats, -1)).unionByName(cells(passing, F.col("fails"), 1))
    sums = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")]]
    return moved.groupBy("part", "cell").agg(*sums)


def contract(tables: np.ndarray, along: dict[str, np.ndarray]) -> np.ndarray:
    """Sum of each part's table with the given selection along the axes of some filters, and all along the others."""
    axes = [along.get(k, ALL) for k in FILTERS]
    return np.einsum("pabcde,a,b,c,d,e->p", tables, *axes)


def order_rows(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[str, int, dict[str, np.ndarray]]]:
    """Each order and step with its figures for all parts; the tables have one leading axis of parts."""
    step = {}
    for letter in FILTERS:
        others = [k for k in FILTERS if k != letter]
        for size in range(len(FILTERS)):
            for before in combinations(others, size):
                here = {k: PASS for k in before} | {letter: FAIL}
                removed = contract(counts, here)
                step[frozenset(before), letter] = {
                    "kept": contract(counts, here | {letter: PASS}),
                    "removed": removed,
                    "redundant": contract(counts, {letter: FAIL}) - removed,
                    "unique_fails": contract(counts, {k: PASS for k in others} | {letter: FAIL}),
                    "good_lost": contract(good, here),
                    "toxic_lost": contract(toxic, here),
                }
    orders = ["".join(o) for o in permutations(FILTERS)]
    shapley = {k: sum(step[frozenset(o[: o.index(k)]), k]["removed"] for o in orders) for k in FILTERS}
    for order in orders:
        for i, letter in enumerate(order):
            yield order, i + 1, step[frozenset(order[:i]), letter] | {"shapley": shapley[letter]}


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(REPORT)
    for whole in batches:
        for at in range(0, whole.num_rows, PARTS):
            batch = whole.slice(at, PARTS)
            parts = batch.column("part")
            tables = np.zeros((3, len(parts), 2 ** len(FILTERS)), dtype=np.int64)
            for p, cells in enumerate(batch.column("cells").to_pylist()):
                for c in cells:
                    tables[:, p, c["cell"]] = c["n"], c["good"], c["toxic"]
            shaped = tables.reshape(3, len(parts), *[2] * len(FILTERS))
            found = []
            for order, i, figures in order_rows(*shaped):
                rest = {"part": parts, "filter_order": [order] * len(parts), "step": [i] * len(parts)} | figures
                found.append(pa.RecordBatch.from_arrays([pa.array(rest[f.name], type=f.type) if f.name != "part" else parts.cast(f.type) for f in schema], schema=schema))
            yield from pa.Table.from_batches(found).combine_chunks().to_batches()


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the five filters and step: what the step keeps, removes, repeats and loses.

    A null text is empty and fails A only (an empty text is no repeat of *itself*, but of an earlier empty one); a null
    part is the empty string. A row without an identifier is no repeat and has no repeats, and no label. Rows that repeat
    an identifier and its text are counted each, and none of them is a repeat of the other. A document is good or
    toxic when any of its label rows says 1. An empty table has no parts, so no rows. Other columns do not matter.
    """
    rows = written(verdict_rows(docs, labels, id_col, text_col, part_col), "audit-rows")
    cells = cell_counts(rows).groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(_report, REPORT)
