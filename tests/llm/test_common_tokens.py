"""The commonest tokens reach the driver as bytes of each task, and are never more than asked for."""

from __future__ import annotations

import random

from siltworks.llm import jaccard_join


def test_commonest_tokens_are_those_of_a_full_sort_but_for_the_last_stretch(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-(1 << 63), 1 << 63), rng.choice([2, 2, 2, 2, 3, 5, 9, 300])) for _ in range(4000)]
    counts = spark.createDataFrame(rows, "token long, n long").repartition(5)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for most in (0, 7, 500, 1999, 2500, 3999, 4000, 9000):
        tokens, levels = jaccard_join._commonest(counts, most)
        got = dict(zip(tokens.view("int64").tolist(), levels.tolist()))
        want = {t: n.bit_length() - 1 for t, n in order[:most]}
        assert len(got) == len(tokens) and got.items() <= want.items() and len(want) - len(got) <= 12
        assert tokens.tolist() == sorted(tokens.tolist())
    tokens, levels = jaccard_join._commonest(counts.limit(0), 10)
    assert len(tokens) == len(levels) == 0


def test_no_row_for_a_token_reaches_the_driver(spark, monkeypatch):
    gathered = []
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "toPandas", lambda self: (_ for _ in ()).throw(AssertionError("a row for each token")))
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: gathered.append(real(self)) or gathered[-1])
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(4)], "uid long, text string").coalesce(1)
    tokens, _ = jaccard_join._frequent(docs, jaccard_join.Rule())
    assert len(tokens) == 2996 and sum(map(len, gathered)) < 100
