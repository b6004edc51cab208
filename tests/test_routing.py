from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dueline.operators import (
    RELEASE_ORDER,
    counters,
    delivery_log,
    ingest,
    known_destinations,
    mark_known_destinations,
    outcome_counts,
    parse_messages,
    requests_of,
    split_unknown_destinations,
)
from dueline.operators import routing
from dueline.plans.event_log import EVENT_TIMING, event_messages, event_requests
from dueline.plans.shared import shared_folder
from dueline.schema import MESSAGE_SCHEMA
from dueline.sources.deliveries import filed, outgoing, read_delivered, write_files
from tests.model import Request
from tests.tables import request_table

SF_DIR = "/root/testdata/sf0.001"
DESTINATIONS = ["a", "0012", "x" * 249, "no/such topic", "é", "", "missing"]


def deliveries(spark):
    requests = [Request(0, i, f"id{i}", i, 10**12, d) for i, d in enumerate(DESTINATIONS)]
    return delivery_log(request_table(spark, requests), payload=True)


def known(spark):
    return spark.createDataFrame([(d,) for d in [*DESTINATIONS[:-1], "a"]], "destination string")


def test_broadcast_and_salted_split_agree(spark):
    for limit in (10_000, 2):
        found, lost = split_unknown_destinations(deliveries(spark), known(spark), limit)
        assert sorted(r.offset for r in found.collect()) == [0, 1, 2, 3, 4, 5]
        assert [r.destination for r in lost.collect()] == ["missing"]
        assert found.columns == deliveries(spark).columns
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_null_destination_is_unknown(spark):
    rows = deliveries(spark).withColumn("destination", F.lit(None).cast("string"))
    found, lost = split_unknown_destinations(rows, known(spark))
    assert (found.count(), lost.count()) == (0, len(DESTINATIONS))


def test_files_keep_any_destination_name(spark):
    path = shared_folder(spark, "files")
    write_files(filed(deliveries(spark), known=known(spark)), path)
    rows = {r.offset: r for r in read_delivered(spark, path).collect()}
    assert {o: r.destination for o, r in rows.items()} == dict(enumerate(DESTINATIONS))
    assert [rows[o].to for o in range(7)] == ["a", "0012", "x" * 249, None, None, None, None]
    assert [rows[o].known for o in range(7)] == [True] * 6 + [False]
    assert rows[0].headers[-1].key == "scheduler.destination"


def test_files_are_in_release_order(spark):
    log = delivery_log(event_requests(spark, SF_DIR), EVENT_TIMING, payload=True)
    path = shared_folder(spark, "files")
    write_files(filed(log), path)
    rows = (
        read_delivered(spark, path)
        .select("to", "delivered_at", "scheduled_sec", "scheduled_nano", "id", F.input_file_name())
        .collect()
    )
    files: dict[str, list] = {}
    for row in rows:
        files.setdefault(row[5], []).append(tuple(row[1:5]))
    assert len(rows) == 382 and len(files) >= 4
    assert all(found == sorted(found) for found in files.values())


def test_outgoing_rows(spark):
    rows = outgoing(deliveries(spark), known=known(spark), ranges=True).collect()
    assert sorted(r.topic for r in rows) == sorted(DESTINATIONS[:-1])
    rows = outgoing(deliveries(spark), known=known(spark), dead_letter_topic="dead").collect()
    assert [bytes(r.value) for r in rows if r.topic == "dead"] == [b"6"]


@pytest.mark.parametrize("salted", [False, True])
def test_outgoing_rows_leave_in_release_order(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(routing.mark_known_destinations, "__defaults__", (0,))
    log = delivery_log(event_requests(spark, SF_DIR), EVENT_TIMING, payload=True)
    names = log.select("destination").distinct()
    rows = outgoing(log, known=names, ranges=True)
    plan = executed(rows)
    # The sort stands above the join, so nothing undoes it.
    assert plan.index("Sort [delivered_at") < plan.index("Join")
    expected = [r.value for r in log.orderBy(*RELEASE_ORDER).select("value").collect()]
    assert [r.value for r in rows.collect()] == expected
    assert "Sort [delivered_at" in executed(outgoing(log, known=names))


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_replay_plan(spark):
    """Partial aggregate before the first shuffle, two shuffles, only the needed columns."""
    plan = executed(delivery_log(event_requests(spark, SF_DIR), EVENT_TIMING))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_max" in plan
    assert "Nested" not in plan and "Cartesian" not in plan
    assert "value:double" not in plan


@pytest.mark.parametrize("count", [outcome_counts, counters])
def test_counts_read_their_input_once(spark, count):
    plan = executed(count(event_requests(spark, SF_DIR), EVENT_TIMING))
    assert plan.count("FileScan parquet") == 1
    assert "Nested" not in plan and "Cartesian" not in plan


def test_known_destinations_are_measured_in_bytes(spark):
    names = spark.createDataFrame([("a",), ("b" * 200,), ("a",), (None,)], "destination string")
    assert known_destinations(names, 281).few
    assert not known_destinations(names, 280).few
    assert known_destinations(names.limit(0), 0).few
    log = spark.createDataFrame([("t", 0, 1, "a"), ("t", 0, 2, "c"), ("t", 0, 3, None)], "topic string, partition int, offset bigint, destination string")
    for size in (0, 1000):
        marked = mark_known_destinations(log, known_destinations(names, size)).collect()
        assert {r.offset: r.known for r in marked} == {1: True, 2: False, 3: False}


def test_generated_methods_are_short_enough_to_be_compiled(spark):
    """The JVM does not compile methods of more than 8000 bytes."""
    path = shared_folder(spark, "messages")
    event_messages(spark, SF_DIR).write.parquet(path)
    messages = spark.read.schema(MESSAGE_SCHEMA).parquet(path)
    for df in (ingest(messages)[0], ingest(messages)[1], requests_of(parse_messages(messages))):
        plan = df._jdf.queryExecution().executedPlan()
        debug = spark._jvm.org.apache.spark.sql.execution.debug
        stages = getattr(debug, "package").codegenStringSeq(plan).iterator()
        sizes = []
        while stages.hasNext():
            sizes.append(stages.next()._3().maxMethodCodeSize())
        assert sizes and max(sizes) < 8000
