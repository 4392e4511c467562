"""Verified near copies build and move shingle sets only of texts that share a slot with another, and settle every bucket."""

from __future__ import annotations

import random

import duckdb
import pytest

from siltworks import catalog
from siltworks.operators import near_copies
from siltworks.operators.violations import near_duplicate_bands


@pytest.mark.parametrize("broadcast", [True, False])
def test_sets_of_texts_without_a_slot_in_common_are_not_written(spark, monkeypatch, broadcast):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(2000, None), (2001, ""), (None, rows[0][1])]
    written, real = [], near_copies.cut_lineage

    def kept(df):
        out = real(df)
        if "shingles" in out.columns and "anchor" not in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "cut_lineage", kept)
    if not broadcast:
        monkeypatch.setattr(near_copies, "pin_small", lambda df: df)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, near_copies.verified_near_copies(docs, "doc_id", "text").select("doc_id", "anchor", "similarity").collect()))
    assert found == [(1000 + i, i, 1.0) for i in range(5)]
    assert len(written) == 1 and written[0] < 50


def crowded(shared_words: int = 40, own: int = 26, groups: int = 40) -> list[tuple[int, str]]:
    """Unlike texts around one passage, which meet in the passage's slots, and of each a copy and near copies."""
    rng = random.Random(8)
    passage = [f"p{rng.randrange(10_000)}" for _ in range(shared_words)]
    texts = [passage + [f"w{rng.randrange(10_000)}" for _ in range(own)] for _ in range(groups)]
    copies = [[*t[:-e], *[f"e{rng.randrange(10_000)}" for _ in range(e)]] if e else t for t in texts for e in (0, 1, 3, 7)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + copies)]
    return [(rng.randrange(50) * 1000 + i, t) for i, t in rows]


def one_by_one(slots: list[tuple[int, int]], texts: dict[int, str], threshold: float = 0.8) -> list[tuple]:
    """Each member of a slot in turn joins the first leader it is similar to, or leads."""
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, t in texts.items()}
    links: dict[int, int] = {}
    most = 0
    for slot in {s for s, _ in slots}:
        leaders: list[int] = []
        for k in sorted(k for s, k in slots if s == slot):
            leader = next((a for a in leaders if len(sets[k] & sets[a]) >= threshold * len(sets[k] | sets[a]) - 1e-9), None)
            if leader is None:
                leaders.append(k)
            else:
                most = max(most, leaders.index(leader))
                links[k] = min(leader, links.get(k, leader))
    assert most > 8
    return sorted((k, a, len(sets[k] & sets[a]), len(sets[k] | sets[a])) for k, a in links.items())


def slots_of(docs) -> list[tuple[int, int]]:
    return [(r["slot"], r["doc_id"]) for r in near_duplicate_bands(docs, "doc_id", "text").selectExpr("doc_id", "concat(band, ':', bucket) as slot").collect()]


@pytest.mark.parametrize("growth", [2])
def test_every_leader_of_a_bucket_is_found(spark, monkeypatch, growth):
    rows = crowded()
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    monkeypatch.setattr(near_copies, "GROWTH", growth)
    found = near_copies.verified_near_copies(docs, "doc_id", "text")
    want = one_by_one(slots_of(docs), dict(rows))
    assert sorted(map(tuple, found.select("doc_id", "anchor", "shared", "united").collect())) == want


def test_the_query_and_its_statement_go_beyond_the_first_leaders(spark, tmp_path):
    rows = crowded()
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = one_by_one(slots_of(docs), dict(rows))
    got = catalog.queries()["near_copies_verified"](spark, str(tmp_path))
    assert sorted((r["doc_id"], r["anchor"], r["shared"], r["united"]) for r in got.collect()) == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    stated = con.sql(catalog.oracle_sql()["near_copies_verified"]).select("doc_id, anchor, shared, united").fetchall()
    con.close()
    assert sorted(stated) == want


def test_a_key_with_several_texts_and_repeated_rows(spark):
    rows = crowded(groups=6)
    texts = dict(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = sorted(map(tuple, near_copies.verified_near_copies(docs, "doc_id", "text").collect()))
    twice = sorted(map(tuple, near_copies.verified_near_copies(docs.union(docs), "doc_id", "text").collect()))
    assert once == twice and once
    # Two texts under one key: each is measured as it is.
    first = min(texts)
    mixed = docs.union(spark.createDataFrame([(first, "quite another text of its own under the same key"), (90_000, texts[first])], docs.schema))
    found = {r["doc_id"]: r for r in near_copies.verified_near_copies(mixed, "doc_id", "text").collect()}
    size = len(set(zip(*(texts[first].split()[i:] for i in range(3)))))
    assert all(r["shared"] <= r["united"] and r["similarity"] >= 0.8 for r in found.values())
    assert 90_000 in found and (found[90_000]["shared"], found[90_000]["united"]) == (size, size)


def test_an_early_end_counts_leaders_one_by_one(spark):
    rows = crowded()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [near_copies.verified_near_copies(docs, "doc_id", "text", rounds=n).count() for n in (1, 3)]
    assert 0 < found[0] < found[1] < near_copies.verified_near_copies(docs, "doc_id", "text").count()
