"""The filter audit against a plain run of the five filters in every order."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest

from siltworks.llm import filter_audit
from siltworks.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

WORDS = " ".join(f"w{i}" for i in range(210))
SHOUT = " ".join(f"W{i}" for i in range(210))
TEXTS = [WORDS, SHOUT, "w " * 300, "short", "", None, WORDS + " $", "A", WORDS.replace(" ", " "), " \t" + WORDS + "\n\n", "SHORT #", "Ä " * 220]


def brute(docs: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": any((t or "") == text and j is not None and i is not None and j < i for j, t, _ in docs),
        }
        good, toxic = (any(d == i and i is not None and r[k] == 1 for d, *r in labels) for k in (0, 1))
        fails.append((source or "", failed, good, toxic))
    out = {}
    for part in {f[0] for f in fails}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            gone = []
            for step, k in enumerate(order, 1):
                removed = [f for f in left if f[1][k]]
                own = [f for f in fails if f[0] == part and f[1][k]]
                unique = [f for f in own if sum(f[1].values()) == 1]
                shapley[k] += len(removed)
                redundant = sum(f[1][k] for f in gone)
                left, gone = [f for f in left if not f[1][k]], gone + removed
                out[part, order, step] = (len(left), len(removed), redundant, len(unique), sum(f[2] for f in removed), sum(f[3] for f in removed))
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v[:6], shapley[order[step - 1]])
    return out


def found(frame) -> dict[tuple, tuple]:
    rows = frame.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.FIGURES) for r in rows}
    assert len(got) == len(rows)
    return got


def test_every_order_against_plain_filters(spark):
    docs = [(i, TEXTS[(i * 7 + i // 12) % len(TEXTS)], ("a", "b", None, "")[i % 4]) for i in range(60)]
    docs += [(5, WORDS, "a"), (5, WORDS, "b"), (5, WORDS, "a"), (None, WORDS, "a"), (None, WORDS, None)]
    labels = [(i, i % 3 % 2, (i % 5 == 0) * 1) for i in range(0, 60, 2)] + [(4, None, None), (4, 1, 1), (None, 1, 1), (4, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    clashing = frame.selectExpr("*", "1 as id", "2 as mark", "3 as n", "4 as part", "5 as fails", "6 as good")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "7 as good", "8 as id")
    want = brute(docs, labels)
    assert found(filter_audit.audit(frame, told)) == want
    assert found(filter_audit.audit(clashing.repartition(5), told.repartition(3))) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, WORDS, None)], docs.schema)
    got = found(filter_audit.audit(one, labels))
    assert len(got) == 600 and all(v == (1, 0, 0, 0, 0, 0, 0) for v in got.values())


def test_many_parts_fill_several_batches(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "'x' as text", "concat('s', id) as source")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).where("filter_order = 'EABCD' and step = 1 and part <> 's0'").agg({"removed": "sum", "part": "count"}).first()
    assert tuple(got) == (199, 199) or set(got) == {199}


@pytest.mark.parametrize("name", ["op12_filter_audit"])
def test_query_equals_sql(spark, small, name):
    con = connect(small)
    assert compare(QUERIES[name](spark, small).toPandas(), con.sql(ORACLES[name]).df()) is None
    con.close()
