"""A benchmark in several blocks gives what one block gives, in both ways of removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.llm import decontaminate

ITEM = "one two three four five six seven eight nine ten eleven twelve"


def test_blocks_agree_with_one_block(spark):
    rows = [(1, f"before {ITEM} after", "a"), (1, f"before {ITEM} after", "a"), (2, None, None), (3, "", "b"), (None, "solo", "b"), (4, f"{ITEM} thirteen fourteen, solo", "c"), (5, "clean words " * 3000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("uid", "_t", "spans", "items", "n_words", "k0"):
        docs = docs.withColumn(name, F.when(F.col("doc_id") != 1, F.lit("x")))
    items = [("a", ITEM), ("b", "four five six seven eight nine ten eleven twelve thirteen fourteen"), ("c", "solo"), (None, "solo"), ("d", None), ("e", ""), ("c", "solo")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for removed in ("documents", "spans"):
        one, many = (sorted(map(tuple, decontaminate.decontaminate(docs, bench, remove=removed, block_bytes=size).collect()), key=repr) for size in (decontaminate.BLOCK_BYTES, 70))
        assert one == many and len(many) == {"documents": 3, "spans": 7}[removed]
    found = {r["doc_id"]: r for r in decontaminate.hits(docs, bench, ["doc_id", "uid", "_t"], block_bytes=70).collect()}
    assert found[4]["spans"] == [(0, 15)] and found[4]["items"] == ["a", "b", "c", "null"] and found[4]["uid"] == "x"
    assert found[2]["n_words"] == 0 and found[5]["spans"] == [] and found[5]["n_words"] == 6000
    assert decontaminate.decontaminate(docs.limit(0), bench, block_bytes=70).count() == 0


def test_no_task_holds_two_blocks(spark):
    """The plan of what comes back holds one pass of Python over the texts, whatever the number of blocks."""
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(str(i), f"{ITEM} {i}") for i in range(8)], "item_id string, text string")
    plan = decontaminate.hits(docs, bench, ["doc_id"], block_bytes=100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
