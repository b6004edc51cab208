"""Counts over requests and deliveries. All are aggregates with map-side partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.operators.replay import survivor_counts, with_admission
from dueline.schema import Timing

# The labels of the processed-records counter.
VALID = ("transform()", "Valid")
INVALID = ("transform()", "Invalid")
SCHEDULED = ("transform()", "Scheduled")
FORWARDED = ("punctuate()", "Forward")


def outcome_counts(requests: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """Number of requests per outcome, without labelling every single request.

    The accepted requests that were not delivered are the superseded ones.
    """
    totals = survivor_counts(with_admission(requests, timing), timing)
    superseded = F.col("accepted") - F.col("delivered")
    counts = stacked(
        expired=F.col("expired"),
        over_max_delay=F.col("over_max_delay"),
        superseded=superseded,
        delivered=F.col("delivered"),
    )
    return totals.select(counts.alias("outcome", "requests")).filter(F.col("requests") > 0)


def counters(requests: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """The processed-records counter by operation and label. Requests without an id are invalid."""
    totals = survivor_counts(with_admission(requests, timing), timing)
    refused = F.col("expired") + F.col("over_max_delay")
    records = {
        VALID: F.col("accepted") + refused,
        INVALID: F.col("nameless"),
        SCHEDULED: F.col("accepted"),
        FORWARDED: F.col("delivered"),
    }
    cells = [c for (a, b), n in records.items() for c in (F.lit(a), F.lit(b), n)]
    return totals.select(F.stack(F.lit(len(records)), *cells).alias("operation", "label", "records"))


def stored_counters(requests: DataFrame, commits: DataFrame) -> DataFrame:
    """The processed-records counter of a stream from what it has stored: its request log with ``refusal``
    (the intake table has it) and the commits of its deliveries. Both take a micro-batch that is run again
    once, so the counts are right after any restart. The log's one column is read, and no delivery."""
    taken = requests.agg(F.count(F.lit(1)).alias("valid"), F.count_if(F.col("refusal").isNull()).alias("scheduled"))
    sent = commits.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("forwarded"))
    records = {VALID: F.col("valid"), INVALID: F.lit(0).cast("bigint"), SCHEDULED: F.col("scheduled")}

    def rows(totals: DataFrame, records: dict) -> DataFrame:
        cells = [c for (a, b), n in records.items() for c in (F.lit(a), F.lit(b), n)]
        return totals.select(F.stack(F.lit(len(records)), *cells).alias("operation", "label", "records"))

    return rows(taken, records).unionByName(rows(sent, {FORWARDED: F.col("forwarded")}))


def stacked(**columns: Column) -> Column:
    """A row (name, value) for each column."""
    return F.stack(F.lit(len(columns)), *[c for n, v in columns.items() for c in (F.lit(n), v)])


def forwarded_per_tick(deliveries: DataFrame) -> DataFrame:
    """How many messages each tick released."""
    return deliveries.groupBy("delivered_at").agg(F.count(F.lit(1)).alias("forwarded"))


def quarantine_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("reason", "detail").agg(F.count(F.lit(1)).alias("messages"))
