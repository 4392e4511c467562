"""Scores where nothing could be learnt, and short pages between boilerplate, through the operators the queries use."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.llm import line_dedup, toxicity
from siltworks.llm.queries import ORACLES, QUERIES, TOXIC_AT
from tests.oracle import compare, connect


def test_no_labels_call_nothing_toxic(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}.") for i in range(40)] + [(99, None), (98, "")], "doc_id long, text string")
    for labels in ([], [(i, 1, 0) for i in range(40)], [(i, None, None) for i in range(40)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        scored = toxicity.score(docs, model, ["doc_id"])
        assert not model.learnt and scored.count() == 42 and scored.where(F.col("score") >= TOXIC_AT).count() == 0
        assert toxicity.drop_toxic(docs, model).count() == 42


def test_pages_that_are_mostly_boilerplate_lose_it(spark):
    head, foot = "a head line that stands on every site", "a foot line that stands on every site as well"
    rows = [(i, f"{head}\nown {i}\n{foot}", f"s{i % 12}") for i in range(24)] + [(100 + i, "whole text\nof two lines", f"s{i}") for i in range(12)] + [(200, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_cut"]) for r in line_dedup.dedup_lines(docs, report=True, most_cut=None).collect()}
    assert all(got[i] == (f"own {i}", 3, 2) for i in range(24))
    assert all(got[100 + i] == ("whole text\nof two lines", 2, 0) for i in range(12)) and got[200] == (None, 0, 0)


def test_query_equals_sql(spark, small):
    con = connect(small)
    assert compare(QUERIES["op9_line_dedup"](spark, small).toPandas(), con.sql(ORACLES["op9_line_dedup"]).df()) is None
    con.close()
