"""Large tables: text columns are judged value by value, folds are dealt evenly, reports are worked out once."""

from __future__ import annotations

import datetime as dt

import pytest

from siltworks.operators import inference as inf
from siltworks.operators import splitting as sp
from siltworks.operators import violations as vl


@pytest.fixture
def mixed(spark):
    """Dates in two formats, units, null tokens, addresses and nulls; each value many times, the last column none twice."""
    return spark.range(1200).selectExpr(
        "id",
        "case id % 6 when 0 then '2026-13-01' when 1 then '01/31/2020' when 2 then null when 3 then '2099-05-01' else '2020-01-31' end as day",
        "case id % 5 when 0 then '10 kg' when 1 then 'n/a' when 2 then null else '12' end as size",
        "case when id % 4 = 0 then null else concat('u', cast(id % 7 as string), '@example.com') end as mail",
        "concat('own ', cast(id as string)) as own",
        "case id % 3 when 0 then -1.0D when 1 then double('Infinity') else 5.0D end as amount",
    )


def test_repeated_columns_are_those_with_short_values_that_come_often(mixed, monkeypatch):
    assert inf.repeated_texts(mixed) == []
    monkeypatch.setattr(inf, "MANY_ROWS", 1000)
    assert inf.repeated_texts(mixed) == ["day", "size", "mail"]
    assert inf.repeated_texts(mixed.selectExpr("repeat(day, 30) as day")) == []


def test_findings_are_the_same_value_by_value(mixed):
    repeated = ["day", "size", "mail"]
    assert inf.inferred_with_length(mixed, repeated=repeated) == inf.inferred_with_length(mixed, repeated=[])
    rules = vl.Rules(target="amount", as_of=dt.date(2026, 1, 1), row_rules={"size <> '12'": "size"})
    want = vl.detect(mixed, rules, repeated=[]).collect()
    assert len(want) > 6 and vl.detect(mixed, rules, repeated=repeated).collect() == want
    rules.target = "size"
    assert vl.detect(mixed, rules, repeated=repeated).collect() == vl.detect(mixed, rules, repeated=[]).collect()


def test_folds_of_a_large_table_are_dealt_evenly(spark, monkeypatch):
    df = spark.range(0, 3000, 1, 1)
    assert [f.rdd.getNumPartitions() for f in sp.written_folds(df, "id")] == [1, 1, 1]
    monkeypatch.setattr(sp, "EVEN_ROWS", 1000)
    folds = sp.written_folds(df, "id")
    assert {f.rdd.getNumPartitions() for f in folds} == {sp.PER_CORE * spark.sparkContext.defaultParallelism}
    assert [sorted(r[0] for r in f.collect()) for f in folds] == [sorted(r[0] for r in f.collect()) for f in sp.three_way_split(df, "id")]
    sizes = folds[0].rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) <= 2 * min(sizes)
