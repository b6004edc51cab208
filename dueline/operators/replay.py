"""Replay of a request log: what was delivered, when, and what became of every request.

Rules. A request replaces whatever is pending under its id, and this happens before it is looked
at: a request that is then refused cancels the pending one. Every tick releases what is due, after
the arrivals up to and including that tick.

How it is computed. All arrivals of one id between two ticks end in one state, that of the last of
them, so each (id, tick) is first reduced to its last request. This is a plain aggregate with
map-side partials: however many requests one id has, at most one row per tick is shuffled on. Only
then are rows of one id compared with each other, again in bounded groups (see ``next_touch``),
and only narrow columns take part. Payloads are joined back by message id, a key without skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dueline.functions import (
    ceil_to_grid,
    instant_after,
    instant_from_micros,
    instant_to_micros,
)
from dueline.schema import ARRIVAL_ORDER, MESSAGE_ID, PAYLOAD, Timing

RELEASE_ORDER = ["delivered_at", "scheduled_sec", "scheduled_nano", "id"]
# What is known of a delivery without its payload.
DELIVERY_COLUMNS = [
    "id",
    *ARRIVAL_ORDER,
    "scheduled_sec",
    "scheduled_nano",
    "destination",
    "delivered_at",
]
# Window groups cover this many times the longest delay; see next_touch.
REACHES_PER_SPAN = 4
# Ids that a replay may be told to reduce first; they become constants of its plan.
MOST_BUSY_IDS = 10_000


def with_admission(requests: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """Judge each request on its own: is it accepted, and at which tick would it fire?

    Adds ``refusal`` (expired, over_max_delay or null), ``fire_at`` and ``arrival_tick``.
    Expiry is compared with the scheduled time, the delay with the arrival cut to milliseconds.
    """
    arrival_ms = F.col("arrival_us") - F.pmod(F.col("arrival_us"), F.lit(1000))
    limit_sec, limit_nano = instant_from_micros(arrival_ms + timing.max_delay_us)
    scheduled = F.col("scheduled_sec"), F.col("scheduled_nano")
    lives = instant_after(F.col("expires_sec"), F.col("expires_nano"), *scheduled)
    in_reach = instant_after(limit_sec, limit_nano, *scheduled)
    arrival = F.col("arrival_us")
    return requests.withColumns(
        {
            "refusal": F.when(~lives, "expired").when(~in_reach, "over_max_delay"),
            "arrival_tick": ceil_to_grid(arrival, timing.tick_us, timing.origin_us),
            # A request that is refused never fires.
            "fire_at": F.when(
                lives & in_reach,
                ceil_to_grid(
                    F.greatest(instant_to_micros(*scheduled), arrival),
                    timing.tick_us,
                    timing.origin_us,
                ),
            ),
        }
    )


def _narrow(admitted: DataFrame) -> Column:
    """The columns of a request that replay needs, in an order in which the last one wins."""
    return F.struct(
        *ARRIVAL_ORDER,
        "scheduled_sec",
        "scheduled_nano",
        "destination",
        "fire_at",
        "refusal",
        _expired_at_fire().alias("expired_at_fire"),
    )


def _expired_at_fire() -> Column:
    fire_sec, fire_nano = instant_from_micros(F.col("fire_at"))
    return ~instant_after(F.col("expires_sec"), F.col("expires_nano"), fire_sec, fire_nano)


def tick_survivors(admitted: DataFrame, **counts: Column) -> DataFrame:
    """The last request of each id in each tick: the only one of them that is still there when
    the tick comes, or the one whose refusal left nothing there. ``counts`` are further aggregates
    over all requests of the id in the tick, by name."""
    last = admitted.groupBy("id", "arrival_tick").agg(
        F.max(_narrow(admitted)).alias("last"), *[c.alias(name) for name, c in counts.items()]
    )
    return last.select("id", "arrival_tick", "last.*", *counts)


def survivor_counts(admitted: DataFrame, timing: Timing) -> DataFrame:
    """One row: how many requests were expired, over_max_delay, accepted and delivered, and how many
    had no id. The refusals are counted on the way to the deliveries, so the input is read once."""
    refusal, named = F.col("refusal"), F.col("id").isNotNull()
    steps = tick_survivors(
        admitted,
        expired=F.count_if(named & (refusal == "expired")),
        over_max_delay=F.count_if(named & (refusal == "over_max_delay")),
        accepted=F.count_if(named & refusal.isNull()),
        nameless=F.count_if(~named),
    )
    delivered = named & refusal.isNull() & ~_overtaken()
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expired", "over_max_delay", "accepted", "nameless")]
    return next_touch(steps, timing).agg(*sums, F.count_if(delivered).alias("delivered"))


def next_touch(
    survivors: DataFrame, timing: Timing, what_came: str = "refusal"
) -> DataFrame:
    """Add ``next_tick``, the next tick in which the same id was requested again, and
    ``next_refusal``, its ``what_came``; null if it is too late to matter.

    A request can only be overtaken until it fires, that is within the maximum delay and one tick
    (its reach). So time is cut into spans of a few reaches, rows in the first reach of a span are
    copied to the span before, and the look-ahead runs within (id, span). No group holds more rows
    than there are ticks in a span and a reach, no matter how long the log or how busy the id.
    """
    tick = timing.tick_us
    reach = -(-(timing.max_delay_us + tick) // tick) * tick
    span_us = REACHES_PER_SPAN * reach
    since = F.col("arrival_tick") - timing.origin_us
    into_span = F.pmod(since, F.lit(span_us))
    span = F.call_function("div", since - into_span, F.lit(span_us))
    copies = F.when(into_span <= reach, F.array(span, span - 1)).otherwise(F.array(span))
    spread = survivors.withColumns({"own_span": span, "span": F.explode(copies)})
    ahead = Window.partitionBy("id", "span").orderBy(*ARRIVAL_ORDER)
    return (
        spread.withColumns(
            {
                "next_tick": F.lead("arrival_tick").over(ahead),
                "next_refusal": F.lead(what_came).over(ahead),
            }
        )
        .filter(F.col("span") == F.col("own_span"))
        .drop("span", "own_span")
    )


def _overtaken() -> Column:
    return F.coalesce(F.col("next_tick") <= F.col("fire_at"), F.lit(False))


def delivery_log(
    requests: DataFrame,
    timing: Timing = Timing(),
    payload: bool = False,
    strict_expiry: bool = False,
    busy_ids: list[str] | None = None,
) -> DataFrame:
    """One row per delivered request, with ``delivered_at``, its tick in epoch microseconds.

    payload        also join back key, value and headers
    strict_expiry  leave out what has expired by the time it fires; by default expiry is tested
                   only on arrival, against the scheduled time
    busy_ids       the ids with very many requests, if they are known (see ``find_busy_ids``): only
                   these are then reduced to one request per tick, and the rest is shuffled once
                   instead of twice. The result is the same for any list.
    """
    admitted = with_admission(requests, timing)
    if busy_ids is None:
        steps = tick_survivors(admitted)
    else:
        busy = F.col("id").isin(busy_ids)
        others = admitted.filter(~busy).withColumn("last", _narrow(admitted))
        steps = tick_survivors(admitted.filter(busy)).unionByName(
            others.select("id", "arrival_tick", "last.*")
        )
    ahead = next_touch(steps, timing)
    fired = ahead.filter(F.col("refusal").isNull() & ~_overtaken())
    if strict_expiry:
        fired = fired.filter(~F.col("expired_at_fire"))
    log = fired.withColumnRenamed("fire_at", "delivered_at").select(*DELIVERY_COLUMNS)
    # What was refused is never delivered, so its payload need not be shuffled.
    return with_payload(log, admitted.filter(F.col("refusal").isNull())) if payload else log


def find_busy_ids(
    requests: DataFrame, at_least: int = 1_000_000, most: int = MOST_BUSY_IDS
) -> list[str]:
    """The busiest ids with this many requests or more, at most ``most`` of them.

    What is collected is bounded however long the log is. A busy id beyond that is replayed like any
    other, in bounded spans, so no row is lost. Reads only the id column of a stored request log.
    Worth it when the log is replayed often.
    """
    counts = requests.groupBy("id").agg(F.count(F.lit(1)).alias("requests"))
    busy = counts.filter(F.col("requests") >= at_least).orderBy(F.desc("requests"), "id")
    return [row.id for row in busy.select("id").limit(most).collect()]


def with_payload(narrow: DataFrame, requests: DataFrame) -> DataFrame:
    """Join key, value and headers back, by message id."""
    return narrow.join(requests.select(*MESSAGE_ID, *PAYLOAD), MESSAGE_ID)


def cancelled_requests(requests: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """Accepted requests that were waiting when a refused one of the same id took them away.

    What counts is the very next request of the id. Within a tick it is found by a window over that
    (id, tick); for the last request of a tick it is the first one of the next tick in which the id
    was requested again. So no group is larger than what ``next_touch`` or one tick holds.
    """
    admitted = with_admission(requests, timing)
    within = Window.partitionBy("id", "arrival_tick").orderBy(*ARRIVAL_ORDER)
    next_refusal = F.lead(F.struct("refusal")).over(within)
    inside = admitted.withColumns({"next": next_refusal, "next_tick": F.col("arrival_tick")})
    inside = inside.withColumn("next_refusal", F.col("next.refusal"))
    ticks = admitted.groupBy("id", "arrival_tick").agg(
        F.max(_narrow(admitted)).alias("last"), F.min(_narrow(admitted)).alias("first")
    )
    lasts = ticks.select("id", "arrival_tick", "last.*", F.col("first.refusal").alias("first_refusal"))
    between = next_touch(lasts, timing, "first_refusal").filter(_overtaken())
    cancelled = F.col("refusal").isNull() & F.col("next_refusal").isNotNull()
    columns = [
        "id",
        *ARRIVAL_ORDER,
        "destination",
        F.col("next_tick").alias("cancelled_by_tick"),
        F.col("next_refusal").alias("cancelled_by"),
    ]
    return inside.filter(cancelled).select(*columns).unionByName(
        between.filter(cancelled).select(*columns)
    )


def classify(
    requests: DataFrame, timing: Timing = Timing(), as_of_us: int | None = None
) -> DataFrame:
    """Every request with its ``outcome``: expired, over_max_delay, superseded, delivered or, with
    ``as_of_us``, pending. ``delivered_at`` is set for delivered ones.

    With ``as_of_us`` only requests that had arrived by then are looked at.
    """
    if as_of_us is not None:
        requests = requests.filter(F.col("arrival_us") <= as_of_us)
    survived = delivery_log(requests, timing).select(*MESSAGE_ID, "delivered_at")
    admitted = with_admission(requests, timing)
    joined = admitted.join(survived, MESSAGE_ID, "left")
    later = F.lit(False) if as_of_us is None else F.col("delivered_at") > as_of_us
    outcome = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal"))
        .when(F.col("delivered_at").isNull(), "superseded")
        .when(later, "pending")
        .otherwise("delivered")
    )
    delivered_at = F.when(~later, F.col("delivered_at"))
    return joined.select(
        "id",
        *ARRIVAL_ORDER,
        "scheduled_sec",
        "scheduled_nano",
        "destination",
        outcome.alias("outcome"),
        delivered_at.alias("delivered_at"),
    )


def latest_request(requests: DataFrame) -> DataFrame:
    """The last request of each id, whatever came of it."""
    fields = F.struct(
        *ARRIVAL_ORDER,
        "scheduled_sec",
        "scheduled_nano",
        "expires_sec",
        "expires_nano",
        "destination",
    )
    return requests.groupBy("id").agg(F.max(fields).alias("last")).select("id", "last.*")


def pending_snapshot(
    requests: DataFrame, as_of_us: int, timing: Timing = Timing(), payload: bool = False
) -> DataFrame:
    """What is waiting for delivery at an instant, after that instant's arrivals and tick.

    Only the last request of an id can be pending, so this is one aggregate per id. Whatever is
    pending arrived within the maximum delay and one tick before, so only that slice is read.
    """
    oldest = as_of_us - timing.max_delay_us - timing.tick_us
    arrival = F.col("arrival_us")
    arrived = requests.filter((arrival > oldest) & (arrival <= as_of_us))
    admitted = with_admission(arrived, timing)
    last = admitted.groupBy("id").agg(F.max(_narrow(admitted)).alias("last"))
    pending = (
        last.select("id", "last.*")
        .filter(F.col("refusal").isNull() & (F.col("fire_at") > as_of_us))
        .select(
            "id", *ARRIVAL_ORDER, "scheduled_sec", "scheduled_nano", "destination", "fire_at"
        )
    )
    if not payload:
        return pending
    return with_payload(pending, admitted.filter(F.col("refusal").isNull()))


def due(pending: DataFrame, tick_us: int) -> DataFrame:
    """The pending rows that a tick releases, in release order."""
    tick_sec, tick_nano = instant_from_micros(F.lit(tick_us))
    late = instant_after(F.col("scheduled_sec"), F.col("scheduled_nano"), tick_sec, tick_nano)
    return pending.filter(~late).orderBy("scheduled_sec", "scheduled_nano", "id")


def ordered_release(deliveries: DataFrame) -> DataFrame:
    """Deliveries in the order in which they leave: by tick, then scheduled time, then id."""
    return deliveries.orderBy(*RELEASE_ORDER)
