"""The toxicity filter moves each text once and turns only a slice of a batch into Python objects."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa

from siltworks.llm import toxicity
from tests.llm.test_corpus import prose


def _model() -> toxicity.SentenceModel:
    texts = [" ".join(prose(8, i)) + (" grumblefoo" if i % 3 == 0 else "") for i in range(90)]
    return toxicity.fit([t.encode() for t in texts], [int(i % 3 == 0) for i in range(90)], [1.0] * 90)


def test_rows_that_stay_are_unchanged_whatever_their_columns(spark):
    rows = [(i, None if i == 5 else "" if i == 6 else f"word {i} grumblefoo" if i % 4 == 0 else f"word {i} é", dt.datetime(2026, 1, 1 + i % 9), {"k": i}, bytearray([i % 256])) for i in range(600)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, seen timestamp, `a.b` map<string,int>, raw binary").coalesce(1)
    kept = toxicity.drop_toxic(docs, _model())
    assert kept.schema == docs.schema
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["text"] is None or "grumblefoo" not in r["text"])
    as_bytes = docs.selectExpr("doc_id", "cast(text as binary) as text")
    assert toxicity.drop_toxic(as_bytes, _model()).count() == kept.count()


def test_a_text_travels_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    plan = toxicity.drop_toxic(docs, _model())._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce" not in plan and "score" not in plan


def test_batches_are_taken_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["a"])
    parts = list(toxicity._parts(iter([batch, batch.slice(0, 0), batch.slice(0, 3)])))
    assert max(p.num_rows for p in parts) <= 256
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(1000), 0, 1, 2]
