"""A task hands freed memory back when its last row has gone, and not before."""

from __future__ import annotations

import pyarrow as pa

from siltworks.llm import frames


class _Plan:
    """Stands for a DataFrame: keeps what would run in a task."""

    def mapInArrow(self, run, kind):
        return run


def test_memory_goes_back_behind_the_last_batch(spark, monkeypatch):
    times = []
    monkeypatch.setattr(frames, "give_back", lambda: times.append(1))
    run = frames.map_rows(_Plan(), lambda batches: ((i,) for b in batches for i in b.column(0).to_pylist()), "n long")
    out = run(iter([pa.RecordBatch.from_pydict({"n": list(range(5000))})]))
    assert next(out).num_rows == frames.BATCH_ROWS and not times
    assert [b.num_rows for b in out] == [5000 - frames.BATCH_ROWS] and times == [1]


def test_giving_back_leaves_what_is_in_use():
    held = pa.array(range(100_000))
    frames.give_back()
    assert held[99_999].as_py() == 99_999
