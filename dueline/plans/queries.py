"""One query per operator, over the given tables, for the comparison with SQL.

Results are scalars: instants as bigint microseconds or (seconds, nanoseconds), bytes as hex text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dueline.functions import (
    append_header,
    decode_instants,
    destination_bytes,
    encode_metadata,
    id_bytes,
    parse_instants,
    parse_uuid,
    strip_control_headers,
)
from dueline.operators import (
    DestinationList,
    after_cut,
    cancelled_requests,
    classify,
    counters,
    delivery_log,
    due,
    extract_metadata,
    find_busy_ids,
    forwarded_per_tick,
    ingest,
    latest_request,
    offsets_of,
    ordered_release,
    outcome_counts,
    pending_at_cut,
    pending_intervals,
    pending_snapshot,
    pending_through_time,
    quarantine_counts,
    restore_source,
    route,
    mark_known_destinations,
    stored_counters,
    tag_requests,
    tick_survivors,
    with_admission,
)
from dueline.operators.ingest import INSTANT_FIELDS
from dueline.plans.event_log import (
    EVENT_TIMING,
    FAR_TIMING,
    binary_header,
    changing_events,
    event_messages,
    event_requests,
    instant_text,
    messages_of,
    text_headers,
    timed_events,
    with_metadata,
)
from dueline.plans.jobs import (
    deliver_from_intake,
    intake_to_tables,
    last_batch,
    replay_from_intake,
    replay_messages,
    replay_stream_to_files,
    replay_to_files,
    stream_session,
    stream_to_files,
    wait_until_idle,
)
from dueline.plans.shared import shared_folder
from dueline.schema import HEADERS_TYPE, METADATA_FIELDS, US_PER_DAY, HeaderNames
from dueline.sources.deliveries import committed_deliveries, outgoing, read_delivered
from dueline.sources.json_requests import headers_from_json
from dueline.sources.messages import read_files
from dueline.sources.request_log import RequestLogById
from dueline.streaming.intake import (
    quarantine_in,
    read_intake,
    requests_in,
    start_narrow_delivery,
    with_logged_payload,
)
from dueline.streaming.job import (
    FileSink,
    pending_in_state,
    read_request_log,
    schedule_stream,
    start_file_delivery,
    start_request_log,
)
from dueline.streaming.state import state_history

NAMES = HeaderNames()
# 2024-01-15 00:00:00, and six hours later.
SNAPSHOT_US = 1_705_276_800_000_000
LATER_US = SNAPSHOT_US + 21_600_000_000
# Message files that a micro-batch of a stream takes.
FILES_PER_BATCH = 8
# Messages in a file, on average, where files must follow in time order.
MESSAGES_PER_FILE = 500_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    """Register a query under the name of the operator it shows."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def header_text(headers: Column) -> Column:
    """A header list as text, values in hex."""
    each = F.transform(headers, lambda h: F.concat(h["key"], F.lit("="), F.hex(h["value"])))
    return F.array_join(each, ";")


def log_columns(log: DataFrame) -> DataFrame:
    return log.select(
        "id",
        "offset",
        "arrival_us",
        "scheduled_sec",
        "scheduled_nano",
        "destination",
        "delivered_at",
    )


# Replay -------------------------------------------------------------------------------------


@query("delivery_log")
def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_columns(delivery_log(event_requests(spark, sf_dir), EVENT_TIMING))


@query("delivery_log_with_payload")
def replay_with_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = delivery_log(event_requests(spark, sf_dir), EVENT_TIMING, payload=True)
    return log.select(
        "offset", "delivered_at", F.hex("key").alias("key"), F.hex("value").alias("value")
    )


def busy_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all requests under one id."""
    third = F.col("offset") % 3 == 0
    busy = F.lit("ffffffff-0000-0000-0000-000000000000")
    requests = event_requests(spark, sf_dir)
    return requests.withColumn("id", F.when(third, busy).otherwise(F.col("id")))


@query("busy_id_log")
def busy_id_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_columns(delivery_log(busy_requests(spark, sf_dir), EVENT_TIMING))


@query("busy_id_routed_log")
def busy_id_routed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the busy id told apart."""
    requests = busy_requests(spark, sf_dir)
    busy = find_busy_ids(requests, at_least=200)
    return log_columns(delivery_log(requests, EVENT_TIMING, busy_ids=busy))


@query("strict_expiry_log")
def strict_expiry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that live up to a minute past their time: some expire before the tick."""
    requests = with_metadata(short_lived(spark, sf_dir)).withColumn("headers", F.array().cast(HEADERS_TYPE))
    return log_columns(delivery_log(requests, EVENT_TIMING, strict_expiry=True))


def short_lived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_events(spark, sf_dir).withColumn(
        "expires_us", F.col("scheduled_us") + F.col("offset") % 60 * 1_000_000 + 1
    )


@query("admission")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_admission(event_requests(spark, sf_dir), EVENT_TIMING)
    return judged.select("offset", "refusal", "arrival_tick", "fire_at")


@query("last_request_per_tick")
def last_request_per_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = with_admission(event_requests(spark, sf_dir), EVENT_TIMING)
    return tick_survivors(judged).select("id", "arrival_tick", "offset", "refusal")


@query("request_outcomes")
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = classify(event_requests(spark, sf_dir), EVENT_TIMING)
    return outcomes.select("offset", "id", "outcome", "delivered_at")


@query("outcomes_as_of")
def outcomes_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = classify(event_requests(spark, sf_dir), EVENT_TIMING, as_of_us=SNAPSHOT_US)
    return outcomes.select("offset", "id", "outcome", "delivered_at")


@query("cancelled_requests")
def cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cancelled_requests(event_requests(spark, sf_dir), EVENT_TIMING)
    return rows.select("id", "offset", "destination", "cancelled_by_tick", "cancelled_by")


@query("latest_request")
def latest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = latest_request(event_requests(spark, sf_dir))
    return last.select(
        "id", "offset", "arrival_us", "scheduled_sec", "scheduled_nano", "destination"
    )


@query("pending_snapshot")
def pending_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = pending_snapshot(
        event_requests(spark, sf_dir), SNAPSHOT_US, EVENT_TIMING, payload=True
    )
    return pending.select(
        "id", "offset", "destination", "fire_at", F.hex("value").alias("value")
    )


@query("due_at_tick")
def due_at_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = pending_snapshot(event_requests(spark, sf_dir), SNAPSHOT_US, EVENT_TIMING)
    return due(pending, LATER_US).select("id", "offset", "scheduled_sec", "scheduled_nano")


@query("ordered_release")
def released_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ordered_release(delivery_log(event_requests(spark, sf_dir), EVENT_TIMING))
    return log.select("delivered_at", "scheduled_sec", "scheduled_nano", "id", "destination")


# Counts -------------------------------------------------------------------------------------


@query("outcome_counts")
def count_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome_counts(event_requests(spark, sf_dir), EVENT_TIMING)


@query("counters")
def processed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = event_requests(spark, sf_dir)
    return counters(requests, EVENT_TIMING)


@query("forwarded_per_tick")
def count_per_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forwarded_per_tick(delivery_log(event_requests(spark, sf_dir), EVENT_TIMING))


# Headers ------------------------------------------------------------------------------------


def own_header() -> Column:
    return append_header(F.array().cast(HEADERS_TYPE), "trace", F.col("offset").cast("string"))


def extracted(df: DataFrame) -> DataFrame:
    return extract_metadata(df).select("offset", *METADATA_FIELDS, "metadata_reject")


@query("extract_text_headers")
def extract_text_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata from text headers. Every seventh event has no id header."""
    timed = timed_events(spark, sf_dir)
    headers = text_headers(own_header(), NAMES)
    without_id = F.filter(headers, lambda h: h["key"] != NAMES.id)
    tagged = timed.withColumn(
        "headers", F.when(F.col("offset") % 7 == 0, without_id).otherwise(headers)
    )
    return extracted(tagged.select("topic", "partition", "offset", "headers"))


@query("extract_binary_header")
def extract_binary_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata from the binary header, some of them damaged in one of four ways."""
    timed = with_metadata(timed_events(spark, sf_dir))
    encoded = F.hex(encode_metadata({f: F.col(f) for f in METADATA_FIELDS}))
    kind = F.col("offset") % 9
    damaged = (
        F.when(kind == 0, F.substring(encoded, 1, 104))
        .when(kind == 1, F.concat(encoded, F.repeat(F.lit("41"), 250)))
        .when(kind == 2, F.concat(F.lit("55"), F.substring(encoded, F.lit(3), F.length(encoded))))
        .when(
            kind == 3,
            F.concat(
                F.lit("00FFFFFFFFFFFFFFFF"), F.substring(encoded, F.lit(19), F.length(encoded))
            ),
        )
        .otherwise(encoded)
    )
    headers = append_header(own_header(), NAMES.metadata, F.unhex(damaged))
    return extracted(timed.select("topic", "partition", "offset", headers.alias("headers")))


@query("binary_overrides_text")
def binary_overrides_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of headers, with different destinations; every third binary one is broken."""
    timed = with_metadata(timed_events(spark, sf_dir))
    text = append_header(text_headers(own_header(), NAMES), NAMES.destination, F.lit("text.wins"))
    broken = append_header(text, NAMES.metadata, F.lit(b"\x0a\x00"))
    headers = F.when(F.col("offset") % 3 == 0, broken).otherwise(binary_header(text, NAMES))
    return extracted(timed.select("topic", "partition", "offset", headers.alias("headers")))


@query("parse_instant_audit")
def parse_instant_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instant texts in twelve forms, half of them invalid."""
    timed = timed_events(spark, sf_dir)
    text = instant_text(F.col("arrival_us"))
    date, minutes, seconds = (F.substring(text, 1, n) for n in (10, 16, 19))
    third = F.lpad((F.col("offset") % 1000).cast("string"), 3, "0")
    forms = [
        text,
        F.substring(text, 1, 26),
        F.concat(minutes, F.lit("Z")),
        F.concat(F.substring(text, 1, 26), third, F.lit("Z")),
        F.concat(F.substring(text, 1, 26), third, F.lit("0Z")),
        F.lower(text),
        F.concat(F.lit("+1"), text),
        F.concat(F.lit("-"), text),
        F.concat(seconds, F.lit("Z")),
        F.concat(date, F.lit("T24:00:00Z")),
        F.concat(F.substring(text, 1, 4), F.lit("-02-30T00:00:00Z")),
        F.lit(""),
    ]
    chosen = F.element_at(F.array(*forms), (F.col("offset") % len(forms) + 1).cast("int"))
    parsed = parse_instants(timed.select("offset", chosen.alias("text")), {"at": F.col("text")})
    return parsed.select("offset", "at_sec", "at_nano")


@query("parse_zoned_instants")
def parse_zoned_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instant texts with offsets from UTC in eight forms, half of them invalid."""
    timed = timed_events(spark, sf_dir)
    text = instant_text(F.col("arrival_us"))
    micros, seconds = F.substring(text, 1, 26), F.substring(text, 1, 19)
    n = F.col("offset")
    hours, minutes = (F.lpad((n % k).cast("string"), 2, "0") for k in (18, 60))
    forms = [
        F.concat(micros, F.lit("+"), hours, F.lit(":"), minutes),
        F.concat(seconds, F.lit("-"), hours, F.lit(":"), minutes, F.lit(":"), minutes),
        F.lower(F.concat(micros, F.lit("-18:00"))),
        F.concat(seconds, F.lit("+18:00:"), minutes),
        F.concat(seconds, F.lit("+"), hours),
        F.concat(seconds, F.lit("-"), hours, minutes),
        F.concat(text, F.lit("+"), hours, F.lit(":"), minutes),
        F.concat(seconds, F.lit("+"), hours, F.lit(":7"), F.substring(minutes, 2, 1)),
    ]
    chosen = F.element_at(F.array(*forms), (F.expr("offset div 3") % len(forms) + 1).cast("int"))
    parsed = parse_instants(timed.select("offset", chosen.alias("text")), {"at": F.col("text")})
    return parsed.select("offset", "at_sec", "at_nano")


@query("parse_uuid_audit")
def parse_uuid_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = timed_events(spark, sf_dir)
    md5 = F.md5(F.col("offset").cast("string"))
    dashed = F.concat_ws(
        "-", *[F.substring(md5, at, n) for at, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]]
    )
    forms = [
        F.upper(dashed).cast("binary"),
        F.unhex(md5),
        F.substring(dashed, 1, 35).cast("binary"),
        F.concat(F.lit("g"), F.substring(dashed, 2, 35)).cast("binary"),
        F.lit(None).cast("binary"),
    ]
    chosen = F.element_at(F.array(*forms), (F.col("offset") % len(forms) + 1).cast("int"))
    return timed.select("offset", parse_uuid(chosen).alias("id"))


@query("strip_control_headers")
def strip_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control headers twice over, between two headers of the message's own."""
    timed = with_metadata(timed_events(spark, sf_dir))
    headers = text_headers(text_headers(own_header(), NAMES), NAMES)
    headers = append_header(binary_header(headers, NAMES), "type", F.col("destination"))
    stripped = strip_control_headers(headers, NAMES)
    return timed.select("offset", header_text(stripped).alias("headers"))


@query("tag_requests_roundtrip")
def tag_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes written by tagging, and what is read from them again."""
    timed = with_metadata(timed_events(spark, sf_dir)).withColumn("headers", own_header())
    tagged = tag_requests(timed, {f: F.col(f) for f in METADATA_FIELDS}).select(
        "offset", F.element_at("headers", -1)["value"].alias("bytes"), F.size("headers").alias("n")
    )
    decoded = decode_instants(tagged, F.col("bytes"), "read")
    return decoded.select(
        "offset",
        "n",
        F.lower(F.hex("bytes")).alias("bytes"),
        *[F.col(f"read_{f}").alias(f) for f in INSTANT_FIELDS],
        parse_uuid(id_bytes(F.col("bytes"))).alias("id"),
        destination_bytes(F.col("bytes")).cast("string").alias("destination"),
    )


@query("tag_documents")
def tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as messages, tagged in bulk without an id and read back."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.lit("documents").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("doc_id").alias("offset"),
        F.col("lang").cast("binary").alias("key"),
        F.col("text").cast("binary").alias("value"),
        F.timestamp_seconds(F.col("doc_id")).alias("timestamp"),
        F.array().cast(HEADERS_TYPE).alias("headers"),
        F.concat(F.lit("lang."), "lang").alias("destination"),
    )
    tagged = tag_requests(
        documents,
        {
            "scheduled_sec": F.col("offset") + F.length("value"),
            "scheduled_nano": F.lit(1),
            "destination": F.col("destination"),
        },
    ).drop("destination")
    requests, _ = ingest(tagged)
    return requests.select(
        "offset",
        "id",
        "scheduled_sec",
        "scheduled_nano",
        "destination",
        F.md5("value").alias("value_md5"),
        F.size("headers").alias("headers_left"),
    )


@query("json_requests")
def json_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = timed_events(spark, sf_dir)
    body = F.to_json(
        F.struct(
            instant_text(F.col("scheduled_us")).alias("scheduled"),
            F.col("id"),
            F.col("destination"),
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
        )
    )
    messages = timed.select(
        F.lit(None).cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        "topic",
        "partition",
        "offset",
        F.timestamp_micros("arrival_us").alias("timestamp"),
        F.array().cast(HEADERS_TYPE).alias("headers"),
    )
    requests, _ = ingest(headers_from_json(messages))
    return requests.select(
        "offset",
        "id",
        "scheduled_sec",
        "scheduled_nano",
        "expires_sec",
        "destination",
        F.hex("key").alias("key"),
        F.hex("value").alias("value"),
    )


# Ingest, routing and sinks ------------------------------------------------------------------


@query("ingested")
def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, _ = ingest(event_messages(spark, sf_dir))
    return requests.select(
        "offset",
        "arrival_us",
        "id",
        "scheduled_sec",
        "scheduled_nano",
        "expires_sec",
        "expires_nano",
        "created_sec",
        "destination",
        F.hex("key").alias("key"),
        F.hex("value").alias("value"),
        header_text(F.col("headers")).alias("headers"),
    )


@query("empty_payload")
def empty_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which a third have an empty key and another third an empty value."""
    third, empty = F.col("offset") % 3, F.lit(b"")
    messages = event_messages(spark, sf_dir).withColumns(
        {
            "key": F.when(third == 0, empty).otherwise(F.col("key")),
            "value": F.when(third == 1, empty).otherwise(F.col("value")),
        }
    )
    requests, _ = ingest(messages)
    return requests.select("offset", F.hex("key").alias("key"), F.hex("value").alias("value"))


def damaged_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event messages of which some lack a scheduled time or have a broken binary header."""
    messages = event_messages(spark, sf_dir)
    kept = F.filter("headers", lambda h: h["key"] != NAMES.scheduled)
    broken = append_header(own_header(), NAMES.metadata, F.col("value"))
    return messages.withColumn(
        "headers",
        F.when(F.col("offset") % 10 == 4, kept)
        .when(F.col("offset") % 10 == 5, broken)
        .otherwise(F.col("headers")),
    )


@query("quarantined")
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, quarantine = ingest(damaged_messages(spark, sf_dir))
    last = F.element_at("headers", -1)
    return quarantine.select(
        "offset",
        "reason",
        "detail",
        F.hex("value").alias("value"),
        F.concat(last["key"], F.lit("="), last["value"].cast("string")).alias("error_header"),
    )


@query("quarantine_counts")
def count_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine_counts(ingest(damaged_messages(spark, sf_dir))[1])


@query("restore_source")
def replay_raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw messages to what leaves: ingest, replay, restored headers."""
    restored = restore_source(replay_messages(event_messages(spark, sf_dir), EVENT_TIMING))
    return restored.select(
        "offset",
        "delivered_at",
        F.hex("key").alias("key"),
        F.hex("value").alias("value"),
        header_text(F.col("headers")).alias("headers"),
    )


@query("route_by_destination")
def route_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing by the last destination header; every fifth message has none."""
    timed = timed_events(spark, sf_dir)
    twice = append_header(
        append_header(own_header(), NAMES.destination, F.lit("first.choice")),
        NAMES.destination,
        F.col("destination"),
    )
    headers = F.when(F.col("offset") % 5 == 0, own_header()).otherwise(twice)
    return route(timed.withColumn("headers", headers)).select("offset", "to_topic")


def quiet_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The destinations that exist: those of event types that sort before "s"."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type") < "s")
    return events.select(F.concat(F.lit("topic."), "event_type").alias("destination")).distinct()


@query("unknown_destination_split")
def unknown_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = delivery_log(event_requests(spark, sf_dir), EVENT_TIMING)
    marked = mark_known_destinations(log, quiet_destinations(spark, sf_dir))
    return marked.select("offset", "destination", "known")


@query("outgoing_rows")
def outgoing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the Kafka sink, with a topic for what has no destination."""
    log = delivery_log(event_requests(spark, sf_dir), EVENT_TIMING, payload=True)
    known = quiet_destinations(spark, sf_dir)
    rows = outgoing(log, NAMES, known, dead_letter_topic="dead.letters")
    return rows.select(
        "topic",
        F.hex("key").alias("key"),
        F.hex("value").alias("value"),
        header_text(F.col("headers")).alias("headers"),
    )


@query("outgoing_in_order")
def outgoing_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the Kafka sink with their place in the order in which the tasks send them. The
    message is told by its own header."""
    log = replay_messages(event_messages(spark, sf_dir), EVENT_TIMING)
    rows = outgoing(log, NAMES, quiet_destinations(spark, sf_dir), ranges=True)
    # In the upper bits the task, below the row's number there.
    sent = rows.withColumn("number", F.monotonically_increasing_id())
    path = shared_folder(spark, "outgoing")
    sent.write.parquet(path)
    sent = spark.read.schema(sent.schema).parquet(path)
    task = F.shiftright("number", 33)
    sizes = sent.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("task")) - F.col("rows")  # one row per task
    places = F.broadcast(sizes.select("task", before.alias("before")))
    own = F.col("headers")[0]["value"].cast("string").cast("bigint")
    return sent.withColumn("task", task).join(places, "task").select(
        own.alias("offset"),
        "topic",
        (F.col("before") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"),
    )


@query("files_by_destination")
def files_by_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay into files, one directory per known destination, and read them back."""
    known = quiet_destinations(spark, sf_dir)
    path = shared_folder(spark, "files")
    files = replay_to_files(event_messages(spark, sf_dir), path, EVENT_TIMING, known)
    return files.select("offset", "delivered_at", "destination", "known", F.col("to").alias("to_dir"))


# Streams ------------------------------------------------------------------------------------


def message_stream(spark: SparkSession, *parts: DataFrame) -> tuple[SparkSession, DataFrame]:
    """Messages as files, read as a stream; each part is in files of its own, one after the other."""
    path = shared_folder(spark, "messages")
    for part in parts:
        part.write.mode("append").parquet(path)
    return stream_of(spark, path)


def ordered_message_stream(spark: SparkSession, messages: DataFrame) -> tuple[SparkSession, DataFrame]:
    """Messages as a stream of files in time order, so that no micro-batch holds a message that is earlier
    than those of the batch before. One job writes all ranges of time side by side; streams take files by
    their time of change, so the files are then given times in the order of their ranges."""
    time = F.coalesce(F.unix_micros("timestamp"), F.lit(0))
    ranges = -(-messages.count() // MESSAGES_PER_FILE) or 1
    path = shared_folder(spark, "messages")
    messages.repartitionByRange(ranges, time).write.parquet(path)
    in_order(spark, path)
    return stream_of(spark, path)


def in_order(spark: SparkSession, path: str) -> None:
    """Give the files of a folder times of change in the order of the tasks that wrote them. Only names are
    touched, no rows."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [s for s in files.listStatus(folder) if s.getPath().getName().startswith("part-")]
    first = max((s.getModificationTime() for s in parts), default=0)
    for number, part in enumerate(sorted(parts, key=lambda s: s.getPath().getName())):
        files.setTimes(part.getPath(), first + number, -1)


def stream_of(spark: SparkSession, path: str) -> tuple[SparkSession, DataFrame]:
    session = stream_session(spark)
    return session, read_files(session, path, stream=True, files_per_batch=FILES_PER_BATCH)


@query("stream_replay")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream in message time, and what it still holds after the last message."""
    session, messages = ordered_message_stream(spark, event_messages(spark, sf_dir))
    root = shared_folder(spark, "stream")
    out = replay_stream_to_files(session, messages, root, "1 second", EVENT_TIMING)
    return out.select("id", "offset", "destination", "delivered_at")


@query("strict_expiry_stream")
def strict_expiry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as in ``strict_expiry_log``, as a stream in message time whose state keeps the expiry
    and no payload."""
    session, messages = message_stream(spark, messages_of(short_lived(spark, sf_dir)))
    sink = intake_to_tables(session, messages, shared_folder(spark, "stream"), EVENT_TIMING, slot_us=US_PER_DAY)
    out = replay_from_intake(session, sink, "1 second", EVENT_TIMING, slot_us=US_PER_DAY, strict_expiry=True)
    return log_columns(out)


def run_by_clock(spark: SparkSession, sf_dir: str) -> tuple[SparkSession, str, DataFrame]:
    """A stream in clock time over requests that are replaced or cancelled in a later micro-batch."""
    changing = changing_events(spark, sf_dir)
    first, second = (messages_of(changing.filter(F.col("offset") % 2 == n)) for n in (0, 1))
    session, messages = message_stream(spark, first, second)
    root = shared_folder(spark, "stream")
    return session, root, stream_to_files(session, messages, root, FAR_TIMING)


@query("stream_by_clock")
def stream_by_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaves: requests that are due and replaced one that was not."""
    out = run_by_clock(spark, sf_dir)[2]
    return out.select("id", "offset", "destination", F.hex("value").alias("value"))


@query("state_by_clock")
def state_by_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays in the state: far requests that were neither replaced nor cancelled."""
    session, root, _ = run_by_clock(spark, sf_dir)
    left = pending_in_state(session, FileSink(root).checkpoint("deliveries"))
    return left.select("id", "offset", "destination", "fire_at", F.hex("value").alias("value"))


@query("request_log")
def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's request log, read back and replayed."""
    session, messages = message_stream(spark, event_messages(spark, sf_dir))
    sink = FileSink(shared_folder(spark, "stream"))
    start_request_log(messages, sink, interval=None).awaitTermination()
    stored = read_request_log(session, sink)
    return log_columns(delivery_log(stored, EVENT_TIMING))


# One read, many tables ----------------------------------------------------------------------


@query("intake_tables")
def intake_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and quarantine from one read of a stream of messages, some of them damaged."""
    session, messages = message_stream(spark, damaged_messages(spark, sf_dir))
    sink = intake_to_tables(session, messages, shared_folder(spark, "stream"), EVENT_TIMING, slot_us=US_PER_DAY)
    table = read_intake(session, sink)
    requests = requests_in(table).select(
        F.lit("request").alias("kind"),
        "offset",
        "id",
        F.col("arrival_us").alias("at"),
        F.col("slot").alias("due_day"),
        F.hex("value").alias("value"),
        F.lit(None).cast("string").alias("detail"),
        header_text(F.col("headers")).alias("headers"),
    )
    last = F.element_at("headers", -1)
    bad = quarantine_in(table).select(
        F.lit("quarantine").alias("kind"),
        "offset",
        F.lit(None).cast("string").alias("id"),
        F.unix_micros("timestamp").alias("at"),
        F.lit(None).cast("bigint").alias("due_day"),
        F.hex("value").alias("value"),
        "detail",
        F.concat(last["key"], F.lit("="), F.hex(last["value"])).alias("headers"),
    )
    return requests.unionByName(bad)


@query("intake_replay")
def intake_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay whose state holds no payload: what left between two instants, from the commits that have it."""
    session, messages = message_stream(spark, event_messages(spark, sf_dir))
    sink = intake_to_tables(session, messages, shared_folder(spark, "stream"), EVENT_TIMING, slot_us=US_PER_DAY)
    replay_from_intake(session, sink, "1 second", EVENT_TIMING, slot_us=US_PER_DAY)
    out = read_delivered(session, sink.deliveries, batches=True, from_us=SNAPSHOT_US, to_us=LATER_US)
    return out.select(
        "id", "offset", "delivered_at", F.hex("value").alias("value"), header_text(F.col("headers")).alias("headers")
    )


@query("intake_by_clock")
def intake_by_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the clock, with the log and the state apart: what leaves when the second half has come, and what
    the state holds then, joined with its payload."""
    changing = changing_events(spark, sf_dir)
    session, root = stream_session(spark), shared_folder(spark, "stream")
    path = shared_folder(spark, "messages")
    for half in (0, 1):
        messages_of(changing.filter(F.col("offset") % 2 == half)).write.mode("append").parquet(path)
        sink = intake_to_tables(session, read_files(session, path, stream=True), root, FAR_TIMING, slot_us=US_PER_DAY)
        out = deliver_from_intake(session, sink, FAR_TIMING, slot_us=US_PER_DAY)
    left = pending_in_state(session, sink.checkpoint("deliveries"))
    left = with_logged_payload(left, read_intake(session, sink), US_PER_DAY)
    columns = ["id", "offset", "destination", F.hex("value").alias("value")]
    return out.select(F.lit(True).alias("left"), *columns).unionByName(left.select(F.lit(False).alias("left"), *columns))


@query("changing_destinations")
def changing_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A destination that is made while the stream runs: messages that came before are dead letters, later
    ones are not."""
    timed = timed_events(spark, sf_dir).withColumns(
        {"id": F.concat(F.lit("00000000-0000-0000-0002-"), F.lpad(F.col("offset").cast("string"), 12, "0")), "scheduled_us": F.col("arrival_us"), "expires_us": F.col("arrival_us") + 1}
    )
    session, root = stream_session(spark), shared_folder(spark, "stream")
    known, path = DestinationList(f"{root}/destinations"), shared_folder(spark, "messages")
    quiet = quiet_destinations(spark, sf_dir)
    halves = [messages_of(timed.filter(F.col("offset") % 2 == half)) for half in (0, 1)]
    known.publish(quiet.filter(F.col("destination") < "topic.d"))
    halves[0].write.parquet(path)
    requests, _ = ingest(read_files(session, path, stream=True))
    running = start_file_delivery(schedule_stream(requests, FAR_TIMING), FileSink(root), known)
    try:
        wait_until_idle(running)
        known.publish(quiet)
        halves[1].write.mode("append").parquet(path)
        # A micro-batch may have begun before the files were there, but not the one after it.
        wait_until_idle(running, after=running.lastProgress.batchId + 1)
    finally:
        running.stop()
    out = read_delivered(session, FileSink(root).deliveries, batches=True)
    return out.select("offset", "destination", "known", F.col("to").alias("to_dir"))


@query("stream_counters")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed-records counter of a stream that was stopped half way, from its tables."""
    session, root = stream_session(spark), shared_folder(spark, "stream")
    path, messages = shared_folder(spark, "messages"), event_messages(spark, sf_dir)
    middle = F.timestamp_micros(F.lit(SNAPSHOT_US))
    for part in (messages.filter(F.col("timestamp") < middle), messages.filter(F.col("timestamp") >= middle)):
        part.write.mode("append").parquet(path)
        sink = intake_to_tables(session, read_files(session, path, stream=True), root, EVENT_TIMING, slot_us=US_PER_DAY)
        start_narrow_delivery(session, sink, EVENT_TIMING, None, None, NAMES, "1 second", US_PER_DAY).awaitTermination()
    replay_from_intake(session, sink, "1 second", EVENT_TIMING, slot_us=US_PER_DAY)
    log = read_intake(session, sink).filter(F.col("kind") == "request")
    return stored_counters(log, committed_deliveries(sink.deliveries).commits(session))


# The log by id, time lines, hand-over -------------------------------------------------------


@query("compacted_log")
def compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay of the request log laid out by id, with a third of all requests under one id."""
    log = RequestLogById(shared_folder(spark, "log"))
    log.compact(busy_requests(spark, sf_dir), buckets=8, busy_at_least=200)
    return log_columns(log.read(spark).delivery_log(EVENT_TIMING))


@query("pending_through_time")
def pending_at_all_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_through_time(event_requests(spark, sf_dir), EVENT_TIMING)


@query("pending_intervals")
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pending_intervals(event_requests(spark, sf_dir), EVENT_TIMING)
    return found.select("id", "offset", "entered", "left")


# Offsets of the second half of the log that is handed over.
SECOND_HALF = 1_000_000_000_000


def backward_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which all even ones come before all odd ones, with timestamps that run backwards."""
    messages = messages_of(changing_events(spark, sf_dir))
    place = F.col("offset") + F.col("offset") % 2 * SECOND_HALF
    return messages.withColumn("timestamp", F.timestamp_micros(F.lit(SNAPSHOT_US) - place % SECOND_HALF * 1000)).withColumn("offset", place)


@query("hand_over")
def hand_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay up to a cut and a stream from there: together what one stream gives. Before the cut are the
    even messages and the odd ones of the first half of the ids."""
    session, root, path = stream_session(spark), shared_folder(spark, "stream"), shared_folder(spark, "messages")
    messages = backward_messages(spark, sf_dir)
    messages.write.parquet(path)
    half = messages.agg(F.max(F.col("offset") % SECOND_HALF)).first()[0] or 0
    logged, _ = ingest(read_files(session, path))
    cut = offsets_of(logged.filter(F.col("offset") < SECOND_HALF + half // 2))
    live, _ = ingest(read_files(session, path, stream=True))
    deliveries = schedule_stream(after_cut(live, cut), FAR_TIMING, initial_pending=pending_at_cut(logged, cut, FAR_TIMING))
    running = start_file_delivery(deliveries, FileSink(root))
    try:
        wait_until_idle(running)
    finally:
        running.stop()
    out = read_delivered(session, FileSink(root).deliveries, batches=True)
    left = pending_in_state(session, FileSink(root).checkpoint("deliveries"))
    columns = ["id", (F.col("offset") % SECOND_HALF).alias("offset"), "destination", F.hex("value").alias("value")]
    return out.select(F.lit(True).alias("left"), *columns).unionByName(left.select(F.lit(False).alias("left"), *columns))


@query("state_history")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who was held, replaced, cancelled and released, before and after the second half came."""
    changing = changing_events(spark, sf_dir)
    session, root, path = stream_session(spark), shared_folder(spark, "stream"), shared_folder(spark, "messages")
    checkpoint, ends = FileSink(root).checkpoint("deliveries"), []
    for half in (0, 1):
        messages_of(changing.filter(F.col("offset") % 2 == half)).write.mode("append").parquet(path)
        out = stream_to_files(session, read_files(session, path, stream=True), root, FAR_TIMING)
        ends.append(last_batch(session, checkpoint))
    rows = state_history(session, checkpoint, out, to_batch=ends[1])
    return rows.select("id", (F.col("batch") > ends[0]).alias("second"), "change", "offset", "by_offset")


@query("state_moved")
def state_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay that is stopped half way and goes on with another number of state partitions."""
    session, root = stream_session(spark), shared_folder(spark, "stream")
    path, messages = shared_folder(spark, "messages"), event_messages(spark, sf_dir)
    sink, out = FileSink(root), FileSink(f"{root}/second")
    middle = F.timestamp_micros(F.lit(SNAPSHOT_US))
    messages.filter(F.col("timestamp") < middle).write.parquet(path)
    intake_to_tables(session, read_files(session, path, stream=True), root, EVENT_TIMING, slot_us=US_PER_DAY)
    session.conf.set("spark.sql.shuffle.partitions", "3")
    first = replay_from_intake(session, sink, "1 second", EVENT_TIMING, slot_us=US_PER_DAY, drain=False)
    cut = written_cut(session, offsets_of(requests_in(read_intake(session, sink))))
    messages.filter(F.col("timestamp") >= middle).write.mode("append").parquet(path)
    intake_to_tables(session, read_files(session, path, stream=True), root, EVENT_TIMING, slot_us=US_PER_DAY)
    held = pending_in_state(session, sink.checkpoint("deliveries"))
    other = stream_session(spark)
    other.conf.set("spark.sql.shuffle.partitions", "5")
    second = replay_from_intake(other, sink, "1 second", EVENT_TIMING, None, NAMES, US_PER_DAY, held, cut, out)
    columns = ["id", "offset", "destination", "delivered_at"]
    return first.select(*columns).unionByName(second.select(*columns))


def written_cut(spark: SparkSession, cut: DataFrame) -> DataFrame:
    """A cut as it is now: a row for each partition of the messages, and no longer a look at a table that grows."""
    path = shared_folder(spark, "cut")
    cut.write.parquet(path)
    return spark.read.schema(cut.schema).parquet(path)
