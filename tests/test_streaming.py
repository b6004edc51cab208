from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from dueline.operators import delivery_log, ingest, pending_snapshot
from dueline.plans.jobs import intake_to_tables, replay_from_intake, replay_stream_to_files, stream_to_files
from dueline.plans.shared import shared_folder
from dueline.schema import Timing
from dueline.sources.deliveries import read_delivered
from dueline.sources.messages import read_files
from dueline.streaming.job import (
    FileSink,
    pending_in_state,
    schedule_stream,
    start_file_delivery,
    start_quarantine,
    start_request_log,
)
from tests.tables import binary_metadata, message_table

SECOND = 1_000_000
TIMING = Timing(tick_us=SECOND, max_delay_us=20 * SECOND)


def uuid_of(n: int) -> str:
    return f"00000000-0000-0000-0000-{n:012d}"


def random_messages(seed: int, n: int = 300) -> list[dict]:
    """In order of arrival but for half a second; a third of them under one id."""
    rng = random.Random(seed)
    messages = []
    for offset in range(n):
        arrival = offset * 200_000 + rng.randrange(400_000)
        scheduled = arrival + rng.randrange(-10, 45) * 500_000
        expires = scheduled + rng.choice([0, 1, SECOND, 10**12, 10**12])
        id_ = uuid_of(0 if offset % 3 == 0 else rng.randrange(1, 30))
        at = divmod(scheduled, SECOND)
        header = binary_metadata(
            (at[0], at[1] * 1000), divmod(expires, SECOND), id_=id_, destination=b"d%d" % (offset % 2)
        )
        message = {"headers": [("scheduler.metadata", header)], "timestamp_us": arrival}
        messages.append({**message, "offset": offset, "value": b"%d" % offset})
    return messages


def write_in_files(spark, messages: list[dict], path: str, size: int) -> None:
    for start in range(0, len(messages), size):
        part = message_table(spark, messages[start : start + size])
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def keys(df) -> list[tuple]:
    return sorted((r.offset, r.delivered_at, bytes(r.value)) for r in df.collect())


def test_replayed_stream_equals_batch_across_a_restart(spark):
    messages = random_messages(1)
    path, root = shared_folder(spark, "in"), shared_folder(spark, "out")
    write_in_files(spark, messages[:150], path, 50)
    stream = read_files(spark, path, stream=True, files_per_batch=1)
    replay_stream_to_files(spark, stream, root, "1 second", TIMING, drain=False)
    first = read_delivered(spark, f"{root}/deliveries", batches=True).count()

    write_in_files(spark, messages[150:], path, 50)
    stream = read_files(spark, path, stream=True, files_per_batch=1)
    out = replay_stream_to_files(spark, stream, root, "1 second", TIMING)
    assert 0 < first < out.count()

    log = delivery_log(ingest(read_files(spark, path))[0], TIMING, payload=True)
    # What is due after the last message is drained: nothing is missing, in six micro-batches and more.
    assert keys(out) == keys(log)


@pytest.mark.parametrize("payload", [True, False])
def test_strict_expiry_in_message_time_equals_batch(spark, payload):
    messages = random_messages(3)
    path, root = shared_folder(spark, "in"), shared_folder(spark, "out")
    write_in_files(spark, messages, path, 100)
    if payload:
        stream = read_files(spark, path, stream=True, files_per_batch=1)
        out = replay_stream_to_files(spark, stream, root, "1 second", TIMING, strict_expiry=True)
    else:
        sink = intake_to_tables(spark, read_files(spark, path, stream=True), root, TIMING)
        out = replay_from_intake(spark, sink, "1 second", TIMING, strict_expiry=True)
    requests = ingest(read_files(spark, path))[0]
    log = delivery_log(requests, TIMING, payload=True, strict_expiry=True)
    assert keys(out) == keys(log) and 0 < log.count() < delivery_log(requests, TIMING).count()


def test_strict_expiry_by_the_clock(spark):
    """Past times are due at once: what has expired since stays out, and still takes the place of another."""
    now = int(time.time())

    def request(offset, id_, due, expires):
        header = binary_metadata((due, 0), (expires, 0), id_=uuid_of(id_), destination=b"a")
        return {"headers": [("scheduler.metadata", header)], "timestamp_us": now * SECOND + offset, "offset": offset, "value": b"%d" % offset}

    rows = [
        request(0, 0, now - 60, now - 30),
        request(1, 1, now - 60, now + 10**6),
        request(2, 2, now + 600, now + 10**6),
        request(3, 2, now - 60, now - 30),
        request(4, 3, now + 600, now + 601),
    ]
    for strict, leave in ((True, [1]), (False, [0, 1, 3])):
        path, root = shared_folder(spark, "in"), shared_folder(spark, "out")
        write_in_files(spark, rows, path, 10)
        out = stream_to_files(spark, read_files(spark, path, stream=True), root, strict_expiry=strict)
        assert sorted(r.offset for r in out.collect()) == leave
        held = pending_in_state(spark, f"{root}/checkpoints/deliveries").collect()
        assert [r.offset for r in held] == [4] and (not strict or held[0].expires_us == (now + 601) * SECOND)


def test_stream_by_the_clock(spark):
    """Delivery on time, replacement, cancelling, dead letters and what stays pending."""
    path, root = shared_folder(spark, "in"), shared_folder(spark, "out")
    now = int(time.time())

    def request(offset, id_, due, destination=b"a", expires=None):
        header = binary_metadata(
            (due, 0), expires or (due + 10**6, 0), id_=uuid_of(id_), destination=destination
        )
        return {
            "headers": [("own", b"1"), ("scheduler.metadata", header)],
            "timestamp_us": now * SECOND + offset,
            "offset": offset,
            "value": b"%d" % offset,
        }

    write_in_files(
        spark,
        [
            request(0, 0, now + 30),
            request(1, 1, now + 600),
            request(2, 2, now + 600),
            request(3, 3, now + 5000),
            request(4, 4, now - 100, b"nowhere"),
            {"headers": [("own", b"1")], "offset": 5},
        ],
        path,
        10,
    )
    sink = FileSink(root)
    known = spark.createDataFrame([("a",), ("b",)], "destination string")
    timing = Timing(max_delay_us=4000 * SECOND)
    requests, _ = ingest(read_files(spark, path, stream=True))
    running = start_file_delivery(schedule_stream(requests, timing), sink, known)
    try:
        deadline = time.time() + 120
        while time.time() < deadline and not (running.lastProgress and running.lastProgress.batchId > 0):
            time.sleep(0.5)
        # Replace one request, cancel another.
        changes = [
            request(6, 1, now + 1, b"b"),
            request(7, 2, now + 600, expires=(0, 0)),
        ]
        write_in_files(spark, changes, path, 10)
        while time.time() < deadline:
            time.sleep(1)
            if read_delivered(spark, sink.deliveries, batches=True).count() == 3:
                break
    finally:
        running.stop()
    rows = {r.offset: r for r in read_delivered(spark, sink.deliveries, batches=True).collect()}
    assert {o: (r.destination, r.known) for o, r in rows.items()} == {
        0: ("a", True),
        4: ("nowhere", False),
        6: ("b", True),
    }
    assert rows[0].delivered_at >= (now + 30) * SECOND
    assert [(h.key, bytes(h.value)) for h in rows[6].headers] == [
        ("own", b"1"),
        ("scheduler.destination", b"b"),
    ]
    # Nothing is left: one was replaced, one cancelled, one refused.
    assert pending_in_state(spark, sink.checkpoint("deliveries")).count() == 0
    valid = sum(p.observedMetrics["processed_records"]["valid"] for p in running.recentProgress)
    assert valid == 7


def test_start_from_a_pending_snapshot(spark):
    """State that existed before: delivered when due, or replaced by what arrives."""
    messages = random_messages(2)
    path, root = shared_folder(spark, "in"), shared_folder(spark, "out")
    old, new = messages[:150], messages[150:]
    cut = 150 * 200_000
    before, _ = ingest(message_table(spark, old).filter(F.unix_micros("timestamp") <= cut))
    pending = pending_snapshot(before, cut, TIMING, payload=True)
    assert pending.count() > 5
    rest = [m for m in old if m["timestamp_us"] > cut] + new
    write_in_files(spark, rest, path, 1000)
    requests, _ = ingest(read_files(spark, path, stream=True))
    sink = FileSink(root)
    deliveries = schedule_stream(requests, TIMING, "1 second", initial_pending=pending)
    start_file_delivery(deliveries, sink, interval=None).awaitTermination()
    out = read_delivered(spark, sink.deliveries, batches=True)
    left = {r.offset for r in pending_in_state(spark, sink.checkpoint("deliveries")).collect()}
    log = delivery_log(ingest(message_table(spark, messages))[0], TIMING, payload=True)
    expected = [r for r in keys(log.filter(F.col("delivered_at") > cut)) if r[0] not in left]
    assert keys(out) == expected


def test_side_tables_of_the_stream(spark):
    path, root = shared_folder(spark, "in"), shared_folder(spark, "out")
    good = random_messages(3, 20)
    write_in_files(spark, [*good, {"headers": [], "offset": 99}], path, 100)
    sink = FileSink(root)
    messages = read_files(spark, path, stream=True)
    start_quarantine(messages, sink, interval=None).awaitTermination()
    start_request_log(messages, sink, interval=None).awaitTermination()
    assert [r.offset for r in spark.read.parquet(sink.quarantine).collect()] == [99]
    stored = spark.read.parquet(sink.requests)
    assert stored.count() == 20
    assert delivery_log(stored, TIMING).count() == delivery_log(
        ingest(message_table(spark, good))[0], TIMING
    ).count()
