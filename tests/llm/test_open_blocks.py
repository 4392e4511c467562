"""Open windows beside the texts of a block: the surroundings of a block travel once, and every pair is looked at."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from siltworks.llm import substring_dedup

RULE = substring_dedup.Passages()
WIDTH = 2 * (RULE.width - 1 + substring_dedup.DRIFT) + 1


def _near(rng: random.Random, shared: list[int]) -> bytes:
    row = [rng.randrange(1 << 16) if rng.random() < rng.choice([0.0, 0.02, 0.3]) else v for v in shared]
    lead = rng.choice([0, 0, 0, 12, 53])
    return bytes([lead]) + np.array(row[lead : rng.choice([WIDTH, WIDTH, 70])], "<u2").tobytes()


def test_places_are_told_apart_as_one_by_one():
    rng = random.Random(3)
    near = [_near(rng, [7 * j for j in range(WIDTH)]) for _ in range(60)]
    one, two = (np.array([rng.randrange(60) for _ in range(900)]) for _ in range(2))
    got = substring_dedup.Places(near, RULE).may_hold(one, two)
    assert got.tolist() == [bool(substring_dedup.may_hold([near[i]], [near[j]], RULE)[0]) for i, j in zip(one, two)]
    assert 0.05 < got.mean() < 0.95


@pytest.mark.parametrize("size", [1, 3, 17, 1000])
def test_a_block_is_compared_whatever_the_batches(size):
    rng = random.Random(size)
    rows, shared = [], [5 * j for j in range(WIDTH)]
    for key in range(3):
        for block in (0, 1):
            rows += [(key, block, 0, 8 * block + p, 100 + 8 * block + p, rng.randrange(30), _near(rng, shared)) for p in range(8) if block or p]
            rows += sorted((key, block, 1, p, 100 + p, rng.randrange(30), _near(rng, shared)) for p in (rng.randrange(2, 20) for _ in range(5)))
    low, high = 1, 9
    want = []
    for k, b, _, place, uid, at, near in (r for r in rows if r[2]):
        for k2, b2, _, place2, uid2, at2, near2 in (r for r in rows if not r[2]):
            if (k, b) == (k2, b2) and low <= place - place2 < high:
                n = substring_dedup.ENOUGH if substring_dedup.may_hold([near], [near2], RULE)[0] else int(place - place2 == 1 and place2 > 1)
                want += [(uid, uid2, at - at2, n)] if n else []
    kinds = [pa.int64()] * 6 + [pa.binary()]
    whole = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], names=list("abcdefg"))
    parts = (whole.slice(i, size) for i in range(0, len(rows), size))
    got = [tuple(r.values()) for b in substring_dedup._beside(parts, low, high, RULE) for r in b.to_pylist()]
    assert sorted(got) == sorted(want) and want


def test_blocks_of_a_hot_key_leave_out_no_pair(spark, monkeypatch):
    rng = random.Random(9)
    shared = [11 * j for j in range(WIDTH)]
    members = [(1, 1000 + p, rng.randrange(9), p, _near(rng, shared)) for p in range(1, 60)]
    asked = [(1, 1000 + p, rng.randrange(9), p, _near(rng, shared)) for p in range(2, 60, 3)]
    open_ = spark.createDataFrame(asked, "key long, uid long, at long, place int, near binary")
    texts = spark.createDataFrame(members, "key long, y long, y_at long, place int, y_near binary")
    found = {}
    for block in (4, 4096):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        found[block] = sorted(map(tuple, substring_dedup._open_seeds(open_, texts, 1, 16, RULE).collect()))
    want = {}
    for _, x, at, p, near in asked:
        for _, y, y_at, q, y_near in members:
            if 1 <= p - q < 16:
                n = 2 if substring_dedup.may_hold([near], [y_near], RULE)[0] else int(p - q == 1 and q > 1)
                if n:
                    want[x, y, at - y_at] = want.get((x, y, at - y_at), 0) + n
    assert found[4] == found[4096] == sorted((*k, n) for k, n in want.items())
