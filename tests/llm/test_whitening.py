"""Whitening against numpy on the gathered vectors."""

from __future__ import annotations

import numpy as np
import pytest

from siltworks.llm import whitening
from siltworks.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows: list[tuple], kept: int = 16) -> dict[tuple, tuple]:
    usable = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(64 * np.array(v, dtype=np.float32).astype(np.float64)) + 1_000_000 for _, v in usable]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    a = (n * fit - sums) / n
    e, w = np.linalg.eigh(a.T @ a / n)
    order = np.argsort(-e)[:kept]
    z = ((n * x - sums) / n) @ w[:, order] / np.sqrt(e[order])
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return n, e[order], e.sum(), z, deviation, [i for i, _ in usable]


def check(frame, rows, tolerance=1e-9):
    n, e, trace, z, deviation, ids = brute(rows)
    got = frame.orderBy("vec_id", "component").collect()
    assert len(got) == len(ids) * len(e)
    order = np.argsort(ids, kind="stable")
    w = np.array([r["whitened"] for r in got]).reshape(len(ids), len(e))
    signs = np.sign((w * z[order]).sum(axis=0))
    assert np.abs(w - z[order] * signs).max() < tolerance
    assert [r["deviation"] for r in got[:: len(e)]] == [int(v) for v in deviation[order]]
    assert {r["n"] for r in got} == {n}
    assert np.allclose([r["explained"] for r in got[: len(e)]], e / trace, rtol=1e-9)
    assert [r["component"] for r in got[: len(e)]] == list(range(1, len(e) + 1))
    assert max(r["identity_error"] for r in got) < 1e-9


def sample(n: int, d: int, seed: int = 3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * (0.9 ** np.arange(d))[:, None]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(n, d)) @ mix)]


def test_against_numpy(spark):
    rows = sample(400, 20)
    dirty = [(1000, None), (1001, []), (1002, [None] * 20), (1003, [float("nan")] * 20), (1004, [0.5] * 19 + [float("-inf")]), (1005, [0.5] * 19)]
    copies = [(2000 + i, rows[7][1]) for i in range(300)]
    frame = spark.createDataFrame(rows + dirty + copies, SCHEMA).selectExpr("*", "1 as x", "2 as v", "3 as n", "4 as component")
    check(whitening.whitening(frame.repartition(7)), rows + copies)


def test_badly_conditioned_and_constant_dimensions(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 4))
    rows = [(i, [float(np.float32(c)) for c in (v[0] * 1e6, v[1], v[2] / 8, v[3], 3.0, 3.0)]) for i, v in enumerate(base)]
    got = whitening.whitening(spark.createDataFrame(rows, SCHEMA))
    assert got.agg({"component": "max"}).first()[0] == 4
    assert got.agg({"identity_error": "max"}).first()[0] < 1e-6
    n, e, trace, *_ = brute(rows, 4)
    want = [r[0] for r in got.where("vec_id = 0").orderBy("component").select("explained").collect()]
    assert np.allclose(want, e / trace, rtol=1e-6)


def test_tables_without_variance(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitening(empty).count() == 0 and whitening.whitening(empty).columns[0] == "vec_id"
    assert whitening.whitening(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], SCHEMA)).count() == 0
    assert whitening.whitening(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0


def test_null_identifiers_and_fewer_vectors_than_dimensions(spark):
    rows = [(1, [0.0, 1.0, 2.0]), (None, [1.0, 5.0, -2.0]), (None, [1.0, 5.0, -2.0]), (2, [3e38, 0.0, 0.0])]
    got = whitening.whitening(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == [("1", 1), ("None", 1), ("None", 1)]
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 and r["explained"] == pytest.approx(1.0) for r in got)


def test_large_whole_numbers_stay_exact():
    x = np.array([[2**54, -(2**54)], [2**54 + 1, 5]], dtype=np.int64)
    sums = [int(v) for v in x.astype(object).sum(axis=0)]
    got = whitening.scaled_deviation(x, 2, sums)
    assert [[int(v) for v in r] for r in got] == [[2 * int(c) - s for c, s in zip(r, sums)] for r in x]
    big = whitening.scaled_deviation(x, 10**9, [s * 10**9 for s in sums])
    assert int(big[0][0]) == 10**9 * 2**54 - sums[0] * 10**9


def test_query_on_the_given_vectors(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, small), rows, tolerance=1e-6)
