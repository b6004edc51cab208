"""Ids share lanes of the state: as many calls and values as lanes, and the same results."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from dueline.operators import delivery_log, ingest
from dueline.plans.shared import shared_folder
from dueline.sources.deliveries import read_delivered
from dueline.sources.messages import read_files
from dueline.streaming.job import FileSink, pending_in_state, schedule_stream, start_file_delivery
from dueline.streaming.processor import HoldUntilDue
from tests.test_streaming import TIMING, keys, random_messages, write_in_files


class Counted:
    """A state value and its timers that count how often they are asked."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "update":
                self.value = args[0]
            elif name == "clear":
                self.value = None
            elif name == "registerTimer":
                self.timers.add(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])
            return self.value if name == "get" else None

        return call


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def request(n: int, fire_at: int | None, offset: int = 0) -> Row:
    fields = {"arrival_us": offset, "topic": "t", "partition": 0, "offset": offset, "scheduled_sec": 0, "scheduled_nano": 0, "destination": "d"}
    return Row(id=f"i{n}", arrival_tick=0, **fields, fire_at=fire_at)


def test_a_lane_is_one_value_with_one_timer():
    held, state = HoldUntilDue(False, payload=False), Counted()
    held.handle = held.pending = state
    rows = [request(n, 1000 * (100 + n)) for n in range(500)]
    assert list(held.handleInputRows((7,), iter(rows), At(50))) == [] and state.calls <= 3 and state.timers == {100}
    # The first is cancelled, the second put off, a third is due at once.
    changes = [request(0, None, 1), request(1, 10_000_000, 1), request(900, 5000, 1)]
    assert [r.id for r in held.handleInputRows((7,), iter(changes), At(60))] == ["i900"] and state.timers == {102}
    out = list(held.handleExpiredTimer((7,), At(200), At(102)))
    assert [r.id for r in out] == [f"i{n}" for n in range(2, 100)] and 200 in state.timers
    assert list(held.handleExpiredTimer((7,), At(300), At(101))) == []  # an old one


@pytest.mark.parametrize("lanes", [1, 4])
def test_few_lanes_give_the_same_deliveries(spark, lanes):
    messages = random_messages(11, 200)
    path, root = shared_folder(spark, "in"), shared_folder(spark, "out")
    write_in_files(spark, messages, path, 50)
    requests, _ = ingest(read_files(spark, path, stream=True, files_per_batch=1))
    sink = FileSink(root)
    start_file_delivery(schedule_stream(requests, TIMING, "1 second", lanes=lanes), sink, interval=None).awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "pending").load(sink.checkpoint("deliveries"))
    left = {r.offset for r in pending_in_state(spark, sink.checkpoint("deliveries")).collect()}
    assert 0 < state.count() <= lanes and len(left) >= state.count()
    log = delivery_log(ingest(read_files(spark, path))[0], TIMING, payload=True).where(~F.col("offset").isin(left))
    assert keys(read_delivered(spark, sink.deliveries, batches=True)) == keys(log)
