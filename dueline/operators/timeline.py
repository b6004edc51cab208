"""Pending requests through time, and the place where a replay hands over to a stream."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dueline.functions import instant_to_micros
from dueline.operators.replay import next_touch, tick_survivors, with_admission
from dueline.schema import ARRIVAL_ORDER, PAYLOAD, Timing

# The sweep adds up ticks within ranges of this many, and then the ranges.
TICKS_PER_RANGE = 4096


def pending_intervals(requests: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """For every request that was ever pending after a tick: ``entered``, the first such tick, and ``left``,
    the tick that released it or in which its id was requested again. It is pending from the one up to but
    not including the other, so a snapshot as of tick T is all with entered <= T < left."""
    steps = next_touch(tick_survivors(with_admission(requests, timing)), timing)
    left = F.least("fire_at", F.coalesce("next_tick", "fire_at"))
    kept = steps.filter(F.col("refusal").isNull()).withColumns({"entered": F.col("arrival_tick"), "left": left})
    columns = ["id", *ARRIVAL_ORDER, "scheduled_sec", "scheduled_nano", "destination", "fire_at", "entered", "left"]
    return kept.filter(F.col("entered") < F.col("left")).select(*columns)


def pending_through_time(requests: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """tick, entered, left, pending: how many requests came and went at each tick at which any did, and how
    many were pending after it, which holds until the next such tick.

    A sweep without one window over all: changes are summed by tick, with partials before the shuffle; ticks
    are added up within ranges of TICKS_PER_RANGE, whose sums, one row each, give every range its start.
    """
    intervals = pending_intervals(requests, timing)
    ends = F.explode(F.array(F.struct(F.col("entered").alias("tick"), F.lit(1).alias("came")), F.struct(F.col("left").alias("tick"), F.lit(0).alias("came"))))
    changes = intervals.select(ends.alias("end")).groupBy("end.tick").agg(
        F.sum("end.came").alias("entered"), F.sum(1 - F.col("end.came")).alias("left")
    )
    width = TICKS_PER_RANGE * timing.tick_us
    since = F.col("tick") - timing.origin_us
    changes = changes.withColumn("range", F.call_function("div", since - F.pmod(since, F.lit(width)), F.lit(width)))
    sums = changes.groupBy("range").agg(F.sum(F.col("entered") - F.col("left")).alias("change"))
    # A row for each range: ten years of seconds are 77,000.
    starts = sums.select("range", (F.sum("change").over(Window.orderBy("range")) - F.col("change")).alias("start"))
    within = Window.partitionBy("range").orderBy("tick")
    return (
        changes.withColumn("so_far", F.sum(F.col("entered") - F.col("left")).over(within))
        .join(starts, "range")
        .select("tick", "entered", "left", (F.col("start") + F.col("so_far")).alias("pending"))
    )


# Hand-over ---------------------------------------------------------------------------------------


def offsets_of(rows: DataFrame) -> DataFrame:
    """A consistent cut of messages or requests: topic, partition and ``next_offset``, the first offset that
    is not in them; a row for each partition."""
    return rows.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def before_cut(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows before the cut: those that the replay takes. A partition without a cut has none of them."""
    return rows.join(F.broadcast(cut), ["topic", "partition"]).filter(F.col("offset") < F.col("next_offset")).drop("next_offset").select(*rows.columns)


def after_cut(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """All other rows, of a table or a stream: those that the stream takes."""
    joined = rows.join(F.broadcast(cut), ["topic", "partition"], "left")
    return joined.filter(F.col("next_offset").isNull() | (F.col("offset") >= F.col("next_offset"))).select(*rows.columns)


def starting_offsets(cut: DataFrame) -> str:
    """The cut as ``startingOffsets`` of Spark's Kafka source: {"topic": {"0": 17}}."""
    topics: dict[str, dict[str, int]] = {}
    for r in cut.collect():
        topics.setdefault(r.topic, {})[str(r.partition)] = r.next_offset
    return json.dumps(topics, sort_keys=True)


def pending_at_cut(requests: DataFrame, cut: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """What a stream by the clock holds, or is about to release, when it has taken all requests before a cut:
    ``initial_pending`` for one that goes on behind it. Nothing is lost or doubled whatever the timestamps are,
    as the cut is made of offsets: the last request of an id is the one with the highest offset of its
    partition and, of several partitions, the last to arrive."""
    admitted = with_admission(before_cut(requests, cut), timing)
    due = F.greatest(instant_to_micros(F.col("scheduled_sec"), F.col("scheduled_nano")), F.col("arrival_us"))
    admitted = admitted.withColumn("fire_at", F.when(F.col("refusal").isNull(), due))
    narrow = F.struct(*ARRIVAL_ORDER, "scheduled_sec", "scheduled_nano", "destination", "fire_at")
    # Aggregates with partials: a busy id sends on a row for each task.
    by_partition = admitted.groupBy("id", "topic", "partition").agg(F.max_by(narrow, "offset").alias("last"))
    last = by_partition.groupBy("id").agg(F.max("last").alias("last")).select("id", "last.*").filter(F.col("fire_at").isNotNull())
    payload = requests.select("topic", "partition", "offset", *PAYLOAD)
    return last.join(payload, ["topic", "partition", "offset"])
