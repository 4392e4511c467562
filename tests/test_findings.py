"""Findings about shapes, outliers and passes; wide null masks; bounded buffers; transcripts in pieces."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltworks.operators import investigate as iv
from siltworks.operators import runlog as rl
from siltworks.operators import violations as vl
from siltworks.operators.violations import Rules
from siltworks.plans import passes as ps
from siltworks.plans.passes import NEW, PERSISTS, REPAIRED, clean_in_passes
from siltworks.sources.readers import MISSING_TEXTS, read_csv


def test_wide_null_masks_send_at_most_a_number_per_pair(spark):
    """Five hundred columns with gaps of their own: no two rows share a pattern, and still a task sends columns squared."""
    d, n = 500, 400
    rng = np.random.default_rng(5)
    gaps = rng.random((n, d)) < 0.02
    gaps[:, 7] = gaps[:, 3]
    gaps[:, 499] = gaps[:, 63] | (rng.random(n) < 0.01)
    masks = pd.DataFrame({"g": [np.nonzero(r)[0].astype("int32").tolist() for r in gaps]})
    df = spark.createDataFrame(masks, "g array<int>").repartition(3).selectExpr(*[f"case when array_contains(g, {i}) then null else 1 end as c{i}" for i in range(d)])
    want = gaps.astype(int).T @ gaps.astype(int)
    got = {(r["i"], r["j"]): r["both_null"] for r in iv.null_gram(df).collect()}
    assert got == {(i, j): int(want[i, j]) for i in range(d) for j in range(i, d) if want[i, j]}
    top = iv.null_co_occurrence(df, 0.5).collect()
    assert {(r["column_a"], r["column_b"]) for r in top} >= {("c3", "c7"), ("c63", "c499")} and top[0]["overlap"] == 1.0


def test_null_masks_of_few_rows(spark):
    df = spark.createDataFrame([(None, 1.0, None), (1, None, float("nan")), (2, 2.0, 3.0)], "a int, b double, c double")
    assert {(r["i"], r["j"]): r["both_null"] for r in iv.null_gram(df).collect()} == {(0, 0): 1, (0, 2): 1, (1, 1): 1, (1, 2): 1, (2, 2): 2}
    assert iv.null_gram(df.limit(0)).count() == 0


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_last_rows_of_hot_sessions(spark, salts):
    df = spark.range(3000).selectExpr("case when id % 3 < 2 then 0 else id % 40 end as s", "id as seq").repartition(11)
    got = rl.last_n(df, "s", "seq", 20, salts)
    assert got.columns == df.columns
    rows = df.toPandas().sort_values("seq").groupby("s").tail(20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.to_numpy().tolist()))


@pytest.mark.parametrize("size", [1, 7, 64, 10**6])
@pytest.mark.parametrize("hot_rows", [3, 10**9])
def test_pieces_join_to_the_transcript(spark, size, hot_rows):
    rows = [(1, i, "user" if i % 2 else "bot", "x" * (i * 5 % 23) + "é\n") for i in range(12)] + [(2, 1, "bot", ""), (2, 2, "bot", None), (3, 1, "user", None), (4, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv int, turn int, role string, text string")
    whole = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        if text is not None:
            whole.setdefault(c, []).append(f"{role.upper()}: {text}")
    got = rl.transcript_pieces(df, "conv", "turn", "role", "text", size, hot_rows).orderBy("conv", "piece").collect()
    for c, lines in whole.items():
        own = [r for r in got if r["conv"] == c]
        assert "".join(r["text"] for r in own) == "\n\n".join(lines)
        assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == [i * size for i in range(len(own))]
        assert all(len(r["text"]) == size for r in own[:-1]) and 0 < len(own[-1]["text"]) <= size
    assert {r["conv"] for r in got} == set(whole)


@pytest.fixture(scope="module")
def shaped(spark):
    return spark.range(200).selectExpr(
        "id", "case when id % 5 = 0 then concat('AB', id) else concat(id, '-', id) end as code", "concat('name', id) as same",
        "case when id % 3 = 0 then 'a b' when id % 3 = 1 then 'a.b.c' else 'ab 12 x' end as prose", "case when id = 7 then 1e6 else cast(id % 10 as double) end as x",
        "case when id % 50 = 0 then '1;2' else concat(id, '') end as rare",
    )


def test_mixed_shapes_are_told_with_both_counts(shaped):
    got = {r["column"]: r for r in vl.mixed_shapes(shaped, ["code", "same", "prose", "rare"]).collect()}
    assert set(got) == {"code"}
    r = got["code"]
    assert (r["shape"], r["n"], r["second_shape"], r["second_n"], r["shapes"], r["total"]) == ("9.9", 160, "A9", 40, 2, 200)


def test_detect_finds_shapes_and_outliers_on_request(shaped):
    plain = {(r["category"], r["subtype"]) for r in vl.detect(shaped, Rules()).collect()}
    asked = vl.detect(shaped, Rules(shapes=True, outliers=True)).collect()
    assert {("FORMAT_INCONSISTENCY", "SHAPE"), ("OUTLIER", "STATISTICAL")} <= {(r["category"], r["subtype"]) for r in asked} and not plain & {("FORMAT_INCONSISTENCY", "SHAPE"), ("OUTLIER", "STATISTICAL")}
    finding = [r for r in asked if r["subtype"] == "SHAPE"][0]
    assert finding["affected_columns"] == ["code"] and finding["n_rows"] == 40 and finding["evidence"] == "9.9 in 160 and A9 in 40 of 200 values"
    outlier = [r for r in asked if r["subtype"] == "STATISTICAL"]
    assert [(r["affected_columns"], r["n_rows"]) for r in outlier] == [(["x"], 1)]
    assert len({r["violation_id"] for r in asked}) == len(asked)


def test_the_ledger_follows_findings_over_passes(spark):
    df = spark.range(300).selectExpr("id", "case when id % 20 = 0 then null else cast(id as double) end as y", "case when id = 5 then timestamp '2099-01-01' else timestamp '2020-01-01' end as d", "concat('u', id, '@example.com') as contact")
    done = clean_in_passes(df, Rules(target="y", as_of=dt.date(2026, 1, 1)))
    lines = {(r["pass_number"], r["category"], r["columns"]): (r["status"], r["rows_before"], r["n_rows"]) for r in done.ledger_table().collect()}
    assert lines[0, "MISSING_DATA", "y"] == (NEW, None, 15) and lines[1, "MISSING_DATA", "y"] == (REPAIRED, 15, 0)
    assert lines[1, "OUTLIER", "d"] == (REPAIRED, 1, 0) and not any(k[0] > 1 for k in lines if lines[k][0] == NEW)


def test_a_finding_no_step_repairs_persists_and_is_not_tried_again(spark, monkeypatch):
    df = spark.range(100).selectExpr("id", "case when id < 10 then -5.0 else cast(id as double) end as x")
    monkeypatch.setattr("siltworks.operators.cleaning.null_outside", lambda frame, *a: frame)
    done = clean_in_passes(df, Rules(ranges={"x": (0.0, None)}))
    statuses = [(r["pass_number"], r["status"]) for r in done.ledger_table().where("category = 'OUTLIER'").orderBy("pass_number").collect()]
    assert statuses == [(0, NEW), (1, PERSISTS)] and len(done.history) == 2 and [s.action for s in done.steps] == ["null_outside"]
    assert ps.compare_findings(1, [], {}) == []


def test_default_texts_for_missing_values(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f'"{t}",x\n' for t in MISSING_TEXTS) + "kept,x\nnone,x\n")
    got = read_csv(spark, str(path), ["a", "b"])
    assert sorted(r["a"] for r in got.where("a is not null").collect()) == ["kept", "none"] and got.count() == len(MISSING_TEXTS) + 2
    assert got.where(F.col("b") == "x").count() == len(MISSING_TEXTS) + 2
