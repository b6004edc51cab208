from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dueline.operators import (
    cancelled_requests,
    classify,
    counters,
    delivery_log,
    due,
    find_busy_ids,
    forwarded_per_tick,
    latest_request,
    ordered_release,
    outcome_counts,
    pending_snapshot,
)
from dueline.schema import Timing
from tests.model import Request, run
from tests.tables import request_table

SECOND = 1_000_000
NEVER = 10**15
HOUR = Timing(tick_us=SECOND, max_delay_us=3600 * SECOND)


def delivered(spark, requests, timing=HOUR, **options):
    rows = delivery_log(request_table(spark, requests), timing, **options).collect()
    return sorted((r.delivered_at, r.offset) for r in rows)


def at(seconds, offset, due_seconds, id_="x", expires=NEVER, destination="a"):
    return Request(
        int(seconds * SECOND), offset, id_, int(due_seconds * SECOND), expires, destination
    )


CASES = {
    "on time": ([at(0, 0, 60)], [(60, 0)]),
    "too far": ([at(0, 0, 7200)], []),
    "replaced": ([at(0, 0, 60), at(30, 1, 60, destination="b")], [(60, 1)]),
    "cancelled by an expired request": ([at(0, 0, 60), at(30, 1, 60, expires=-(10**15))], []),
    "cancelled by a request too far off": ([at(0, 0, 60), at(30, 1, 9000)], []),
    "expired on arrival": ([at(0, 0, 60, expires=0)], []),
    "expires equal to scheduled": ([at(0, 0, 60, expires=60 * SECOND)], []),
    "expired when due but not when scheduled": ([at(0, 0, 59.5, expires=59_600_000)], [(60, 0)]),
    "earlier update": ([at(0, 0, 300), at(1, 1, 60)], [(60, 1)]),
    "exactly the maximum delay": ([at(0, 0, 3600)], []),
    "a microsecond less": ([Request(0, 0, "x", 3600 * SECOND - 1, NEVER)], [(3600, 0)]),
    "arrival counts in whole milliseconds": ([Request(999, 0, "x", 3600 * SECOND, NEVER)], []),
    "past-dated goes out at the next tick": ([at(10.5, 0, 1)], [(11, 0)]),
    "past-dated, arrival on a tick": ([at(10, 0, 1)], [(10, 0)]),
    "update exactly on the tick wins": ([at(0, 0, 60), at(60, 1, 90)], [(90, 1)]),
    "update after the tick comes too late": ([at(0, 0, 60), at(60.1, 1, 90)], [(60, 0), (90, 1)]),
    "id used again": ([at(0, 0, 5), at(20, 1, 25), at(40, 2, 45)], [(5, 0), (25, 1), (45, 2)]),
    "same arrival, later offset wins": ([at(0, 0, 60), at(0, 1, 61)], [(61, 1)]),
    "accepted again after a cancel": (
        [at(0, 0, 60), at(10, 1, 60, expires=0), at(20, 2, 70)],
        [(70, 2)],
    ),
}


@pytest.mark.parametrize("case", CASES)
def test_case(spark, case):
    requests, expected = CASES[case]
    assert delivered(spark, requests) == [(s * SECOND, o) for s, o in expected]


def random_log(seed: int, n: int = 400) -> list[Request]:
    """Coarse times, so that ties and arrivals on a tick are common, and one busy id."""
    rng = random.Random(seed)
    requests = []
    for offset in range(n):
        arrival = rng.randrange(0, 600) * 250_000
        if rng.random() < 0.3:
            arrival += rng.randrange(1000)
        scheduled = arrival + rng.randrange(-20, 60) * 250_000 + rng.choice([0, 0, 1, 999])
        expires = scheduled + rng.choice([-1, 0, 1, 10**9, 10**9, 10**9])
        id_ = "busy" if rng.random() < 0.35 else f"id{rng.randrange(40)}"
        requests.append(Request(arrival, offset, id_, scheduled, expires, f"d{offset % 3}"))
    return requests


TIMINGS = [
    Timing(tick_us=SECOND, max_delay_us=10 * SECOND),
    Timing(tick_us=SECOND, max_delay_us=10 * SECOND, origin_us=300_000),
    Timing(tick_us=3 * SECOND, max_delay_us=0),
    Timing(tick_us=7 * SECOND, max_delay_us=12 * SECOND, origin_us=-5),
]


@pytest.mark.parametrize("seed", range(4))
def test_random_logs_equal_the_model(spark, seed):
    timing = TIMINGS[seed]
    requests = random_log(seed)
    table = request_table(spark, requests).cache()
    model, left = run(requests, timing.tick_us, timing.max_delay_us, timing.origin_us)
    assert left == []
    expected = sorted((tick, r.offset) for tick, r in model)
    log = delivery_log(table, timing)
    assert sorted((r.delivered_at, r.offset) for r in log.collect()) == expected

    assert find_busy_ids(table, 100) == ["busy"]
    for busy in (["busy"], ["id1", "id2"], []):
        routed = delivery_log(table, timing, busy_ids=busy).collect()
        assert sorted((r.delivered_at, r.offset) for r in routed) == expected

    in_order = [(r.delivered_at, r.offset) for r in ordered_release(log).collect()]
    assert in_order == [(tick, r.offset) for tick, r in model]

    outcomes = classify(table, timing).groupBy("outcome").count().collect()
    counts = {r["outcome"]: r["count"] for r in outcomes}
    assert sum(counts.values()) == len(requests)
    assert counts.get("delivered", 0) == len(expected)
    short = {r["outcome"]: r["requests"] for r in outcome_counts(table, timing).collect()}
    assert short == counts

    per_tick = {r["delivered_at"]: r["forwarded"] for r in forwarded_per_tick(log).collect()}
    assert sum(per_tick.values()) == len(expected)
    for as_of in (20 * SECOND, 73 * SECOND + 1, 110 * SECOND):
        _, pending = run(requests, timing.tick_us, timing.max_delay_us, timing.origin_us, as_of)
        snapshot = pending_snapshot(table, as_of, timing)
        assert sorted(r.offset for r in snapshot.collect()) == [r.offset for r in pending]
        labelled = classify(table, timing, as_of_us=as_of).filter("outcome = 'pending'")
        assert sorted(r.offset for r in labelled.collect()) == [r.offset for r in pending]
        ready = due(snapshot, as_of + 5 * SECOND).collect()
        order = sorted(
            (r for r in pending if r.scheduled_us <= as_of + 5 * SECOND),
            key=lambda r: (r.scheduled_us, r.id),
        )
        assert [r.offset for r in ready] == [r.offset for r in order]


def test_latest_request_and_counters(spark):
    requests = random_log(9, 100)
    table = request_table(spark, requests)
    last = {r.id: r for r in sorted(requests, key=lambda r: (r.arrival_us, r.offset))}
    rows = latest_request(table).collect()
    assert {r.id: r.offset for r in rows} == {k: r.offset for k, r in last.items()}
    log = delivery_log(table, HOUR)
    counted = {(r.operation, r.label): r.records for r in counters(table, HOUR).collect()}
    accepted = [r for r in requests if r.expires_us > r.scheduled_us]
    assert counted["transform()", "Valid"] == 100
    assert counted["transform()", "Invalid"] == 0
    assert counted["transform()", "Scheduled"] == len(accepted)
    assert counted["punctuate()", "Forward"] == log.count()


def test_cancelled_requests_name_the_refusal(spark):
    requests = [
        at(0, 0, 60),
        at(30, 1, 60, expires=0),
        at(0, 2, 60, "y"),
        at(30, 3, 9000, "y"),
        at(0, 4, 60, "z"),
        at(30, 5, 61, "z"),
    ]
    rows = cancelled_requests(request_table(spark, requests), HOUR).collect()
    assert sorted((r.offset, r.cancelled_by) for r in rows) == [
        (0, "expired"),
        (2, "over_max_delay"),
    ]


@pytest.mark.parametrize("accepted_last", [False, True])
def test_cancels_inside_one_tick(spark, accepted_last):
    """The very next request counts, also when both come in the same tick."""
    long_ago = -(10**15)
    requests = [at(0.1, 0, 60), at(0.2, 1, 60, expires=long_ago), at(0.3, 2, 70)]
    if not accepted_last:
        requests.append(at(0.4, 3, 9000))
    rows = cancelled_requests(request_table(spark, requests), HOUR).collect()
    found = sorted((r.offset, r.cancelled_by) for r in rows)
    assert found == [(0, "expired")] + [(2, "over_max_delay")] * (not accepted_last)


def test_strict_expiry_and_payload(spark):
    requests = [at(0, 0, 59.5, "x", 59_600_000), at(0, 1, 59.5, "y", 60_000_000), at(0, 2, 60, "z")]
    assert delivered(spark, requests) == [(60 * SECOND, o) for o in (0, 1, 2)]
    assert delivered(spark, requests, strict_expiry=True) == [(60 * SECOND, 2)]
    log = delivery_log(request_table(spark, requests), HOUR, payload=True)
    assert {r.offset: bytes(r.value) for r in log.collect()} == {0: b"0", 1: b"1", 2: b"2"}


def test_instants_beyond_spark_timestamps(spark):
    table = request_table(spark, [at(5, 0, 0), at(5, 1, 0, "y"), at(5, 2, 0, "z")])
    lowest = table.withColumns(
        {
            "scheduled_sec": F.when(F.col("offset") == 0, -31557014167219200)
            .when(F.col("offset") == 1, 31556889864403199)
            .otherwise(8),
            "scheduled_nano": F.when(F.col("offset") == 2, 1).otherwise(0).cast("int"),
            "expires_sec": F.lit(31556889864403199),
        }
    )
    rows = delivery_log(lowest, HOUR).collect()
    # The smallest instant is long due; a nanosecond past a tick waits for the next one.
    assert sorted((r.offset, r.delivered_at) for r in rows) == [(0, 5 * SECOND), (2, 9 * SECOND)]
