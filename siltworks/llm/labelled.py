"""A bounded sample of labelled rows to fit a classifier on, the same for the same table, and its class weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from siltworks.llm.frames import crc_fold, text_of


@dataclass(frozen=True)
class Bound:
    """At most so many rows of each class, and so many bytes of text in all, reach the driver."""

    rows_per_class: int = 2000
    text_bytes: int = 16 * 1024 * 1024


def _fitting(rows: list[Row], text_bytes: int) -> set[tuple[int, int, int]]:
    """(_id, _y, _mark) of the rows that fit, the shortest of each class first."""
    wanted = {y: sum(r["_n"] for r in rows if r["_y"] == y) for y in (0, 1)}
    fit = set()
    for y in (0, 1):
        room = max(text_bytes // 2, text_bytes - wanted[1 - y])
        for r in sorted((r for r in rows if r["_y"] == y), key=lambda r: (r["_n"], r["_id"], r["_mark"])):
            room -= r["_n"]
            if room < 0:
                break
            fit.add((r["_id"], y, r["_mark"]))
    return fit


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: Bound, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[bytes], list[int], list[float]]:
    """Texts, labels (0 or 1) and weights of sampled rows outside the held-out fold.

    The sample is the rows first in the order of a hash of the identifier, class by class; weights bring back the
    classes' shares among all labelled rows. Null labels, and labels of other values, are left out. Each class has half of
    the bytes, and what the other leaves of its half; where its texts do not fit, the longest are left out.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    known = known.where(F.col("_y").isin(0, 1) & ~crc_fold(F.col("_id"))).dropDuplicates(["_id", "_y"])
    totals = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    order = F.xxhash64(F.lit(17), "_id")
    chosen = [known.where(F.col("_y") == y).orderBy(order, "_id").limit(bound.rows_per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text")).join(ids, "_id")
    # Repeated documents add nothing: one row for each identifier and text, at most the bound again.
    sized = rows.select("_id", "_y", F.xxhash64("_text").alias("_mark"), F.octet_length("_text").alias("_n")).distinct()
    first = [sized.where(F.col("_y") == y).orderBy(order, "_mark").limit(bound.rows_per_class) for y in (0, 1)]
    fit = _fitting(first[0].unionByName(first[1]).collect(), bound.text_bytes)
    kept = docs.sparkSession.createDataFrame(sorted(fit), "_id long, _y int, _mark long") if fit else None
    if kept is None:
        return [], [], []
    marked = rows.withColumn("_mark", F.xxhash64("_text"))
    texts = marked.join(F.broadcast(kept), ["_id", "_y", "_mark"]).dropDuplicates(["_id", "_y", "_mark"]).orderBy("_id", "_y", "_mark").collect()
    ys = [r["_y"] for r in texts]
    share = {y: totals[y] / max(1, ys.count(y)) for y in totals}
    scale = len(ys) / max(1, sum(share[y] for y in ys))
    return [r["_text"].encode() for r in texts], ys, [share[y] * scale for y in ys]
