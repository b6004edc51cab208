"""The log by id, pending requests through time, and the cut at which a replay hands over."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from dueline.operators import (
    after_cut,
    before_cut,
    delivery_log,
    ingest,
    offsets_of,
    pending_at_cut,
    pending_snapshot,
    pending_through_time,
    starting_offsets,
)
from dueline.plans.shared import shared_folder
from dueline.schema import Timing
from dueline.sources.request_log import RequestLogById
from tests.tables import message_table
from tests.test_streaming import SECOND, TIMING, keys, random_messages


def requests_of_seed(spark, seed: int, n: int = 300):
    return ingest(message_table(spark, random_messages(seed, n)))[0]


def test_replay_of_the_log_by_id_is_not_shuffled(spark):
    requests = requests_of_seed(spark, 21)
    log = RequestLogById(shared_folder(spark, "log"))
    assert log.read(spark) is None
    assert log.compact(requests, buckets=4, busy_at_least=50) == requests.count()
    version = log.read(spark)
    assert version.busy_ids == ["00000000-0000-0000-0000-000000000000"]  # a third of all
    assert version.busy.count() == 100 and version.requests().count() == 300
    plan = delivery_log(version.bucketed, TIMING, busy_ids=[])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" in text and "Bucketed: true" in text and "Exchange" not in text
    assert keys(version.delivery_log(TIMING, payload=True)) == keys(delivery_log(requests, TIMING, payload=True))

    # The next version takes its place as a whole; what was read before still is there.
    more = requests.unionByName(requests_of_seed(spark, 22).withColumn("partition", F.lit(9)))
    log.compact(more, buckets=3)
    newer = log.read(spark)
    assert newer.busy_ids == [] and newer.requests().count() == 600 and version.requests().count() == 300
    # A session that never saw the table.
    other = RequestLogById(log.path).read(spark.newSession())
    assert keys(other.delivery_log(TIMING, payload=True)) == keys(delivery_log(more, TIMING, payload=True))
    log.compact(requests.limit(0), buckets=2)
    assert log.read(spark).delivery_log(TIMING).collect() == []


def test_pending_through_time_equals_snapshots(spark):
    requests = requests_of_seed(spark, 23)
    changes = {r.tick: r.pending for r in pending_through_time(requests, TIMING).collect()}
    rng = random.Random(1)
    ticks = sorted(changes)
    for tick in rng.sample(range(ticks[0] // SECOND, ticks[-1] // SECOND + 1), 8):
        before = [t for t in ticks if t <= tick * SECOND]
        assert (changes[before[-1]] if before else 0) == pending_snapshot(requests, tick * SECOND, TIMING).count()
    assert changes[ticks[-1]] == 0 and max(changes.values()) > 5
    assert pending_through_time(requests.limit(0), TIMING).collect() == []


def test_ranges_of_the_sweep_add_up(spark, monkeypatch):
    from dueline.operators import timeline

    requests = requests_of_seed(spark, 24)
    whole = sorted(map(tuple, pending_through_time(requests, Timing(SECOND, 20 * SECOND, 7)).collect()))
    monkeypatch.setattr(timeline, "TICKS_PER_RANGE", 3)
    assert sorted(map(tuple, pending_through_time(requests, Timing(SECOND, 20 * SECOND, 7)).collect())) == whole


def test_cut_by_offsets(spark):
    requests = requests_of_seed(spark, 25, 90).withColumn("partition", F.col("offset").cast("int") % 3)
    cut = offsets_of(requests.filter("partition < 2 and offset < 40"))
    taken, rest = before_cut(requests, cut), after_cut(requests, cut)
    assert {r.offset for r in taken.collect()} == {o for o in range(40) if o % 3 < 2}
    assert taken.count() + rest.count() == 90 and taken.columns == rest.columns == requests.columns
    (topic,) = json.loads(starting_offsets(cut)).values()
    assert topic == {"0": 40, "1": 38}
    none = offsets_of(requests.limit(0))
    assert before_cut(requests, none).count() == 0 and after_cut(requests, none).count() == 90
    assert pending_at_cut(requests, none, TIMING).collect() == []


def test_pending_at_a_cut_takes_the_highest_offset(spark):
    """Whatever the timestamps say, within a partition."""
    messages = [m | {"timestamp_us": 10**9 - m["offset"] * SECOND} for m in random_messages(26, 120)]
    requests = ingest(message_table(spark, messages))[0]
    far = Timing(SECOND, 10**12)
    cut = offsets_of(requests.filter("offset < 100"))
    last = {}
    for r in sorted(requests.filter("offset < 100").collect(), key=lambda r: r.offset):
        last[r.id] = r
    alive = {i: r.offset for i, r in last.items() if (r.expires_sec, r.expires_nano) > (r.scheduled_sec, r.scheduled_nano)}
    held = pending_at_cut(requests, cut, far)
    assert {r.id: r.offset for r in held.collect()} == alive
    assert all(r.value == str(r.offset).encode() for r in held.collect())
