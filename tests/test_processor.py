"""The winner of a micro-batch by the clock, without a stream."""

from __future__ import annotations

import pyarrow as pa
import pytest

from dueline.streaming.job import _last_of_each
from dueline.streaming.processor import HoldUntilDue


def row(offset: int, arrival: int, partition: int = 0) -> dict:
    return {"id": "x", "topic": "t", "partition": partition, "offset": offset, "arrival_us": arrival}


def winner(batches: list[list[dict]]) -> dict:
    """What is left after these Arrow batches, each reduced before the shuffle, and the state step."""
    step = _last_of_each(["id", "topic", "partition"], ["offset"])
    kept = [r for b in batches for out in step(iter([pa.RecordBatch.from_pylist(b)])) for r in out.to_pylist()]
    return HoldUntilDue._last_by_clock(iter(kept))


@pytest.mark.parametrize("cut", [0, 1, 2, 3])
def test_highest_offset_wins_though_timestamps_run_backwards(cut):
    rows = [row(9, 95), row(10, 100), row(11, 90)]
    assert winner([b for b in (rows[:cut], rows[cut:]) if b])["offset"] == 11


def test_across_partitions_the_last_to_arrive_wins():
    rows = [row(10, 100), row(11, 90), row(3, 95, 1), row(2, 99, 1)]
    assert winner([rows])["partition"] == 1
    assert winner([rows])["offset"] == 3
