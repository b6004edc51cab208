"""Requests go through the state as one binary: the same values come out, and Python is given few cells."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from dueline.operators import ingest
from dueline.plans.jobs import stream_session
from dueline.plans.shared import shared_folder
from dueline.sources.messages import read_files
from dueline.streaming import processor
from dueline.streaming.job import FileSink, pending_in_state, schedule_stream, start_file_delivery
from dueline.streaming.processor import HoldUntilDue
from tests.test_lanes import At, Counted
from tests.test_streaming import TIMING, random_messages, write_in_files

HEADERS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())]))
ODD = [[], None, [{"key": "a", "value": b"1"}, {"key": None, "value": None}, None], [{"key": "é", "value": b""}]]


def batch() -> pa.RecordBatch:
    n, columns = len(ODD), {}
    for name in ["arrival_us", "partition", "offset", "scheduled_sec", "scheduled_nano", "fire_at"]:
        columns[name] = pa.array([None, *range(1, n)], pa.int64())
    columns |= {"id": ["x", "y", None, "z"], "topic": ["t"] * n, "destination": [None, "d", "", "e"]}
    columns |= {"key": [None, b"", b"\x00", b"k"], "value": [b"v", None, b"", b"w"], "headers": pa.array(ODD, HEADERS)}
    return pa.record_batch(columns)


def test_packed_requests_are_what_they_were():
    names = processor.request_names(processor.PENDING_FIELDS)
    # Slices have an offset of their own.
    for rows in (batch(), batch().slice(1), batch().slice(2, 1)):
        back = processor.unpack_requests(processor.pack_requests(rows, names).to_pylist(), names)
        assert "payload" not in back and set(back) == {*rows.schema.names, "arrival_tick"}
        for name in rows.schema.names:
            assert pa.array(back[name], rows.schema.field(name).type).to_pylist() == rows.column(name).to_pylist()


def test_what_is_held_is_the_binary_that_came():
    names = processor.request_names(processor.PENDING_FIELDS)
    rows = batch().slice(3)
    request = processor.pack_requests(rows, names).to_pylist()[0]
    held, state = HoldUntilDue(False, binary=True), Counted()
    held.handle = held.pending = state
    assert list(held.handleInputRows((7,), iter([Row(lane=7, request=request)]), At(0))) == []
    assert processor.unpacked(state.value[1]) == {"z": (1, request)}
    assert [(r.delivered_at, r.request) for r in held.handleExpiredTimer((7,), At(5), At(1))] == [(5000, request)]


def test_the_state_is_given_no_nested_columns(spark):
    path, root = shared_folder(spark, "in"), shared_folder(spark, "out")
    write_in_files(spark, random_messages(11, 60), path, 50)
    requests, _ = ingest(read_files(spark, path, stream=True))
    out = schedule_stream(requests, TIMING, "1 second")
    plan = out._jdf.queryExecution().analyzed().toString()
    given = next(x for x in plan.split("\n") if "TransformWithState" in x)
    assert "request#" in given and "headers#" not in given
    start_file_delivery(out, FileSink(root), interval=None).awaitTermination()
    left = pending_in_state(spark, FileSink(root).checkpoint("deliveries"))
    sent = {r.offset: r for r in ingest(read_files(spark, path))[0].collect()}
    rows = left.where(F.col("timer_ms") * 1000 >= F.col("fire_at")).collect()
    assert rows and all((r.key, r.value, r.headers) == (sent[r.offset].key, sent[r.offset].value, sent[r.offset].headers) for r in rows)


def test_many_files_are_listed_by_few_tasks(spark):
    assert int(stream_session(spark).conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 64
