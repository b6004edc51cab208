"""Schedule requests and messages made from the ``events`` table.

Each event asks for a delivery ``k * 10 min - 30 min`` after it happened, under its user's id;
``error`` events are already expired and so cancel what the user has pending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.functions import append_header, encode_metadata, instant_from_micros
from dueline.schema import (
    HEADERS_TYPE,
    INSTANT_MIN,
    METADATA_FIELDS,
    REQUEST_COLUMNS,
    US_PER_DAY,
    HeaderNames,
    Timing,
)

US_PER_MINUTE, US_PER_HOUR = 60_000_000, 3_600_000_000
TEN_MINUTES, HALF_HOUR = 10 * US_PER_MINUTE, 30 * US_PER_MINUTE
EVENT_TIMING = Timing(tick_us=US_PER_MINUTE, max_delay_us=12 * US_PER_HOUR)
# 2100-01-01 00:00:00, and a delay that reaches it.
FAR_US = 4_102_444_800_000_000
FAR_TIMING = Timing(tick_us=US_PER_MINUTE, max_delay_us=200 * 365 * US_PER_DAY)
# Every 17th event gets no control headers at all.
UNTAGGED_EVERY = 17


def local_micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp without time zone, read as UTC whatever the session's
    time zone is."""
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * US_PER_DAY
        + F.hour(ts).cast("bigint") * US_PER_HOUR
        + F.minute(ts).cast("bigint") * US_PER_MINUTE
        + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    )


def instant_text(us: Column) -> Column:
    """ISO text of an instant given in epoch microseconds, for years 0 to 9999."""
    in_day = F.pmod(us, F.lit(US_PER_DAY))
    date = F.date_from_unix_date(F.call_function("div", us - in_day, F.lit(US_PER_DAY)).cast("int"))

    def digits(value: Column, width: int) -> Column:
        return F.lpad(value.cast("string"), width, "0")

    def whole(step: int) -> Column:
        return F.call_function("div", in_day, F.lit(step))

    return F.concat(
        date.cast("string"),
        F.lit("T"),
        digits(whole(US_PER_HOUR), 2),
        F.lit(":"),
        digits(whole(US_PER_MINUTE) % 60, 2),
        F.lit(":"),
        digits(whole(1_000_000) % 60, 2),
        F.lit("."),
        digits(in_day % 1_000_000, 6),
        F.lit("Z"),
    )


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the times, id, destination and payload of their request."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        "user_id",
        "event_type",
        "props",
        local_micros(F.col("ts")).alias("arrival_us"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    )
    scheduled = F.col("arrival_us") + F.col("k") * TEN_MINUTES - HALF_HOUR
    timed = events.withColumn("scheduled_us", scheduled)
    expires = F.when(F.col("event_type") == "error", F.col("arrival_us") - US_PER_HOUR).otherwise(
        F.col("scheduled_us") + US_PER_DAY
    )
    return timed.select(
        F.lit("events").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        "arrival_us",
        "scheduled_us",
        expires.alias("expires_us"),
        F.concat(
            F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("user_id").cast("string"), 12, "0")
        ).alias("id"),
        F.concat(F.lit("topic."), "event_type").alias("destination"),
        F.col("user_id").cast("string").cast("binary").alias("key"),
        F.col("props").cast("binary").alias("value"),
    )


def with_metadata(timed: DataFrame) -> DataFrame:
    scheduled_sec, scheduled_nano = instant_from_micros(F.col("scheduled_us"))
    expires_sec, expires_nano = instant_from_micros(F.col("expires_us"))
    return timed.withColumns(
        {
            "scheduled_sec": scheduled_sec,
            "scheduled_nano": scheduled_nano,
            "expires_sec": expires_sec,
            "expires_nano": expires_nano,
            "created_sec": F.lit(INSTANT_MIN[0]),
            "created_nano": F.lit(INSTANT_MIN[1]),
        }
    )


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as requests, with the columns every operator expects."""
    return (
        with_metadata(timed_events(spark, sf_dir))
        .withColumn("headers", F.array().cast(HEADERS_TYPE))
        .select(*REQUEST_COLUMNS)
    )


def text_headers(headers: Column, names: HeaderNames) -> Column:
    """Control headers in text form, from the columns of ``timed_events``."""
    for name, value in [
        (names.scheduled, instant_text(F.col("scheduled_us"))),
        (names.expires, instant_text(F.col("expires_us"))),
        (names.id, F.col("id")),
        (names.destination, F.col("destination")),
    ]:
        headers = append_header(headers, name, value)
    return headers


def binary_header(headers: Column, names: HeaderNames) -> Column:
    encoded = encode_metadata({f: F.col(f) for f in METADATA_FIELDS})
    return append_header(headers, names.metadata, encoded)


def event_messages(
    spark: SparkSession, sf_dir: str, names: HeaderNames = HeaderNames()
) -> DataFrame:
    """The events as raw messages."""
    return messages_of(timed_events(spark, sf_dir), names)


def messages_of(timed: DataFrame, names: HeaderNames = HeaderNames()) -> DataFrame:
    """Rows of ``timed_events`` as raw messages with one header of their own. Even ones carry text
    control headers, odd ones the binary header, every 17th none."""
    tagged = F.col("offset") % UNTAGGED_EVERY != 0
    as_text = tagged & (F.col("offset") % 2 == 0)
    as_bytes = tagged & (F.col("offset") % 2 == 1)
    possible = [
        ("trace", F.col("offset").cast("string")),
        (names.scheduled, F.when(as_text, instant_text(F.col("scheduled_us")))),
        (names.expires, F.when(as_text, instant_text(F.col("expires_us")))),
        (names.id, F.when(as_text, F.col("id"))),
        (names.destination, F.when(as_text, F.col("destination"))),
        (names.metadata, F.when(as_bytes, encode_metadata({f: F.col(f) for f in METADATA_FIELDS}))),
    ]
    each = [
        F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))
        for name, value in possible
    ]
    headers = F.filter(F.array(*each), lambda h: h["value"].isNotNull())
    return with_metadata(timed).select(
        "key",
        "value",
        "topic",
        "partition",
        "offset",
        F.timestamp_micros("arrival_us").alias("timestamp"),
        headers.cast(HEADERS_TYPE).alias("headers"),
    )


def changing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests whose end is the same however the log is cut into micro-batches.

    Each even event asks for a time in the far future, under an id of its own. The odd event behind
    it, by turns, replaces it with a request that is due, takes it away by a refused one, or leaves
    it alone under another id.
    """
    timed = timed_events(spark, sf_dir)
    even, turn = F.col("offset") % 2 == 0, F.pmod(F.call_function("div", F.col("offset"), F.lit(2)), F.lit(3))
    number = F.when(~even & (turn == 2), F.col("offset")).otherwise(F.col("offset") - F.col("offset") % 2)
    waits = even | (turn == 2)
    scheduled = F.when(waits, F.lit(FAR_US) + F.col("offset") * 1_000_000).otherwise(F.col("arrival_us"))
    refused = ~even & (turn == 1)
    return timed.withColumns(
        {
            "id": F.concat(F.lit("00000000-0000-0000-0001-"), F.lpad(number.cast("string"), 12, "0")),
            "scheduled_us": scheduled,
            "expires_us": F.when(refused, scheduled - 1_000_000).otherwise(scheduled + US_PER_DAY),
        }
    )
