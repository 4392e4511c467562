"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort places equals side by side, and each row
is compared in full with the one before it. The splitters are over (leading characters, 64-bit mark, identifier), so
what is sampled and sent to every task is narrow, and a text that many rows share is split between tasks by identifier.
Runs that touch the border of a task are put together again afterwards: at most two cells per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.frames import ascii_lower, map_rows, octets, text_of, written

LEAD = 24
RUNS = "doc long, part int, run long, head long, size long, first boolean, sha string, edge binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a sorted partition with their run; ``edge`` holds the text of runs in the first and the last cell.

    A cell is the rows of one (lead, mark): one run, or several where different texts collide.
    """
    part = TaskContext.get().partitionId()
    cell: list[tuple[bytes, list]] = []  # runs of the open cell: text and identifiers
    key, run, cells = None, 0, 0

    def close(last: bool) -> Iterator[tuple]:
        nonlocal run
        for text, docs in cell:
            sha = hashlib.sha256(text).hexdigest()
            edge = text if last or cells == 1 else None
            for i, doc in enumerate(docs):
                yield doc, part, run, docs[0], len(docs), i == 0, sha, edge if i == 0 else None
            run += 1

    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), octets(batch.column(1))
        marks = zip(octets(batch.column(2)), batch.column(3).to_pylist())
        for doc, text, here in zip(docs, texts, marks):
            if here != key:
                if key is not None:
                    yield from close(last=False)
                cell, key, cells = [], here, cells + 1
            if cell and cell[-1][0] == text:
                cell[-1][1].append(doc)
            else:
                cell.append((text, [doc]))
    if key is not None:
        yield from close(last=True)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after lower-casing A-Z; null counts as empty. Of a group the row with the
    smallest (or ``keep="largest"``) identifier stays, null identifiers coming last; of repeated rows exactly one stays.
    An empty table gives no rows; other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    largest = keep == "largest"
    norm = ascii_lower(text_of(text_col))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), norm.alias("norm"))
    rows = rows.select("doc", "norm", F.substring("norm", 1, LEAD).alias("lead"), F.xxhash64("norm").alias("mark"))
    order = F.desc_nulls_last("doc") if largest else F.asc_nulls_last("doc")
    sorted_rows = rows.repartitionByRange("lead", "mark", order).sortWithinPartitions("lead", "mark", "norm", order)
    placed = written(map_rows(sorted_rows, _runs, RUNS), "exact-runs")
    # Equal texts on both sides of a border: full texts are the key, at most two cells per task.
    best = F.max if largest else F.min
    edges = placed.where(F.col("edge").isNotNull()).groupBy("edge").agg(
        best("head").alias("keep"), F.sum("size").alias("total"),
        F.array_sort(F.collect_list(F.struct(F.col("head").isNull().alias("none"), (-F.col("head") if largest else F.col("head")).alias("rank"), "part", "run"))).alias("parts"),
    )
    whole = edges.where(F.size("parts") > 1).select("keep", "total", F.posexplode("parts").alias("at", "p"))
    whole = whole.select("keep", "total", (F.col("at") == 0).alias("owner"), F.col("p.part").alias("part"), F.col("p.run").alias("run"))
    joined = placed.drop("edge").join(F.broadcast(whole), ["part", "run"], "left")
    return joined.select(
        F.col("doc").alias("doc_id"),
        F.when(F.col("total").isNull(), F.col("head")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("total", "size").alias("group_size"),
        (F.col("first") & F.coalesce("owner", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
