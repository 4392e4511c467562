"""Repeated passages: the stream of sorted keys, texts hashed together, the order of copies, and recall by length and edits."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from siltworks.llm import jaccard_join, substring_dedup
from tests.llm.test_corpus import docs_of, prose

RULE = substring_dedup.Passages()


def test_texts_hashed_together_are_as_hashed_alone():
    known = jaccard_join._Hashes()
    texts = [" ".join(prose(n, 50 + n)).encode() for n in (300, 0, 3, 49, 50, 5, 4, 120)] + [b"a " * 200, b"", b"x y " * 80]
    rows = substring_dedup.shingle_rows(texts, RULE.shingle, known)
    alone = [substring_dedup.shingle_row(t, RULE.shingle, known) for t in texts]
    for i, own in enumerate(alone):
        assert rows.h[rows.text == i].tolist() == own.tolist()
    together = [sorted(zip(k.tolist(), rows.text[at].tolist(), (at - rows.start[at]).tolist())) for k, at in substring_dedup.window_keys(rows, RULE.width)]
    singly = [[] for _ in together]
    for i, t in enumerate(texts):
        for held, (k, at) in zip(singly, substring_dedup.window_keys(substring_dedup.shingle_rows([t], RULE.shingle, known), RULE.width)):
            held += [(x, i, y) for x, y in zip(k.tolist(), at.tolist())]
    assert together == [sorted(x) for x in singly] and any(together)
    everywhere = np.arange(len(rows.h))
    marks, at = substring_dedup.stretches(rows, RULE.width, everywhere)
    assert at.tolist() == [j for j in range(len(rows.h)) if j + RULE.width <= rows.end[j]]
    same: dict[int, set] = {}
    for m, j in zip(marks.tolist(), at.tolist()):
        same.setdefault(m, set()).add(tuple(rows.h[j : j + RULE.width].tolist()))
    assert all(len(v) == 1 for v in same.values()) and len(same) == len({x for v in same.values() for x in v})


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_ties_of_sorted_keys_whatever_the_batches(size):
    rng = random.Random(size)
    for _ in range(40):
        rows = sorted({(rng.randrange(6), rng.randrange(5), rng.randrange(40)) for _ in range(rng.randrange(60))})
        want = []
        for k, u, a in rows:
            others = sorted({v for key, v, _ in rows if key == k})
            if len(others) > 1:
                least = {v: min(b for key, w, b in rows if (key, w) == (k, v)) for v in others}
                y, prev = others[0], max((v for v in others if v < u), default=others[0])
                want.append((k, u, a, y, a - least[y], prev, a - least[prev]))
        whole = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["key", "uid", "at"])
        parts = [whole.slice(i, size) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in substring_dedup._ties(iter(parts)) for r in b.to_pylist()]
        assert sorted(got) == want


def test_the_first_copy_has_the_smallest_identifier_on_every_layout(spark):
    text, passage = " ".join(prose(90, 1)), prose(70, 2)
    rows = [(9, text, "a"), (4, text, "b"), (None, text, "c"), (7, " ".join(prose(30, 3) + passage), "a"), (2, " ".join(passage + prose(30, 4)), "a"), (5, " ".join(prose(20, 5) + passage), "a")]
    seen = []
    for order in (rows, rows[::-1]):
        df = docs_of(spark, order).coalesce(1)
        seen.append(sorted((str(r["doc_id"]), r["match_id"], r["start"], r["end"]) for r in substring_dedup.repeats(df).collect()))
        texts = {r["doc_id"]: r["text"] for r in substring_dedup.cut_repeats(df).collect()}
        assert texts[4] == text and not texts[9].split() and not texts[None].split() and len(texts[2].split()) == 100 and len(texts[5].split()) == 20
    assert seen[0] == seen[1] == [("5", 2, 20, 90), ("7", 2, 30, 100), ("9", 4, 0, 90), ("None", 4, 0, 90)]


def test_exact_stretches_equal_brute_force(spark):
    rng = random.Random(11)
    passages = [prose(rng.randint(40, 75), 500 + i) for i in range(8)]
    rows = []
    for i in range(40):
        own = prose(rng.randint(0, 90), 600 + i)
        for p in rng.sample(passages, rng.randint(0, 2)):
            cut = rng.randint(0, len(own))
            own = own[:cut] + p + own[cut:]
        rows.append((i, " ".join(own), "a"))
    rows += [(40, rows[3][1], "a"), (41, "", "a"), (42, None, "a")]
    first: dict[tuple, int] = {}
    for i, t, _ in rows:
        words = (t or "").split()
        for j in range(len(words) - RULE.words + 1):
            first.setdefault(tuple(words[j : j + RULE.words]), i)
    found = substring_dedup.repeats(docs_of(spark, rows)).collect()
    for i, t, _ in rows:
        words = (t or "").split()
        own = [(r["start"], r["end"]) for r in found if r["doc_id"] == i]
        for j in range(len(words) - RULE.words + 1):
            if first[tuple(words[j : j + RULE.words])] != i:
                assert any(a <= j and j + RULE.words <= b for a, b in own), (i, j)
    texts = {i: (t or "").split() for i, t, _ in rows}
    for r in found:
        one = jaccard_join.shingle_set(" ".join(texts[r["doc_id"]][r["start"] : r["end"]]).encode(), RULE.shingle, jaccard_join._Hashes())
        two = jaccard_join.shingle_set(" ".join(texts[r["match_id"]][r["match_start"] : r["match_end"]]).encode(), RULE.shingle, jaccard_join._Hashes())
        assert 100 * len(np.intersect1d(one, two)) >= RULE.percent * len(np.union1d(one, two)) and r["match_id"] < r["doc_id"]


def test_recall_of_near_copies_by_length_and_edits(spark):
    """One word edited; in half of the cases an earlier text holds 44 words of the passage."""
    rows, wanted = [], {}
    for case in range(400):
        n, partial = (55, 60, 70, 90, 120)[case % 5], case % 2
        passage = prose(n, 20_000 + case)
        near = list(passage)
        near[n // 2 if n >= 70 else 2] = "edited"
        for k, words in enumerate(((passage[-46:-2] if partial else []), passage, near)):
            own = prose(100, 30_000 + 3 * case + k)
            rows.append((3 * case + k, " ".join(own[: 20 + k] + words + own[20 + k :]), "a"))
        wanted[3 * case + 2] = (partial, n)
    found = {(r["doc_id"], r["match_id"]) for r in substring_dedup.repeats(docs_of(spark, rows)).collect()}
    assert all(a // 3 == b // 3 for a, b in found)
    for partial in (0, 1):
        ids = [i for i, (p, _) in wanted.items() if p == partial]
        recall = sum((i, i - 1) in found for i in ids) / len(ids)
        by_length = {n: sum((i, i - 1) in found for i in ids if wanted[i][1] == n) / sum(wanted[i][1] == n for i in ids) for n in (55, 60, 70, 90, 120)}
        assert recall >= 0.9, (partial, recall, by_length)
        print("recall", partial, recall, by_length)


def test_near_copies_behind_many_texts_with_a_part_of_the_passage(spark):
    """The text that verifies is neither the first with the windows' keys nor the one before: 3 or 20 others hold 44 words of the passage."""
    rows, wanted, uid = [], {}, 0
    for case in range(40):
        n = (55, 60, 70, 90)[case % 4]
        passage = prose(n, 40_000 + case)
        near = list(passage)
        near[n // 2 if n >= 70 else 2] = "edited"
        part, between = passage[-46:-2], (3, 20)[case % 2]
        for k, words in enumerate([part, passage, *[part] * between, near]):
            own = prose(60, 50_000 + uid)
            rows.append((uid, " ".join(own[:20] + words + own[20:]), "a"))
            wanted |= {uid: (uid - between - 1, n)} if words is near else {}
            uid += 1
    found = substring_dedup.repeats(docs_of(spark, rows)).collect()
    caught = [i for i, (j, n) in wanted.items() if any(r["doc_id"] == i and r["match_id"] == j and r["end"] - r["start"] >= n - 4 for r in found)]
    assert len(caught) >= 0.9 * len(wanted)


def test_of_passages_found_later_those_inside_known_ones_are_left_out(spark):
    kind = "x long, y long, start long, end long, match_start long, match_end long, similarity double"
    known = spark.createDataFrame([(1, 0, 10, 70, 10, 70, 1.0), (2, 0, 0, 50, 0, 50, 1.0)], kind)
    found = [(1, 3, 10, 70, 5, 65, 0.9), (1, 4, 15, 68, 5, 58, 0.9), (1, 5, 15, 80, 5, 70, 0.9), (1, 4, 20, 80, 5, 65, 0.9), (3, 5, 0, 60, 0, 60, 0.9), (3, 4, 0, 60, 9, 69, 0.9)]
    left = substring_dedup._outside(spark.createDataFrame(found, kind), known).collect()
    assert sorted((r["x"], r["y"], r["start"], r["end"]) for r in left) == [(1, 5, 15, 80), (3, 4, 0, 60)]


def test_surroundings_that_hold_a_passage_are_never_left_out():
    rng = np.random.default_rng(5)
    reach, least = RULE.width - 1 + substring_dedup.DRIFT, -(-2 * RULE.width * RULE.percent // (100 + RULE.percent))
    near, others, want = [], [], []
    for _ in range(300):
        x, y = (rng.integers(0, 1 << 16, 2 * reach + 1).astype("<u2") for _ in range(2))
        common, start = int(rng.integers(30, 47)), int(rng.integers(substring_dedup.DRIFT, reach + 1))
        drift = int(rng.integers(-substring_dedup.DRIFT, substring_dedup.DRIFT + 1))
        places = start + np.sort(rng.permutation(RULE.width)[:common])
        y[places + drift] = x[places]
        near.append(b"\0" + x.tobytes())
        others.append(b"\0" + y.tobytes())
        want.append(common >= least)
    got = substring_dedup.may_hold(near, others, RULE)
    assert got[np.array(want)].all() and got[~np.array(want)].mean() < 0.2
    edges = [bytes([reach]) + np.arange(reach + 1, dtype="<u2").tobytes(), bytes([reach - 3]) + np.arange(8, dtype="<u2").tobytes()]
    assert substring_dedup.may_hold(edges, edges, RULE).tolist() == [True, False]
