"""The delayed-delivery job as a Structured Streaming query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from dueline.functions import instant_to_micros
from dueline.operators import (
    RELEASE_ORDER,
    DestinationList,
    KnownDestinations,
    known_destinations,
    parse_messages,
    quarantine_of,
    requests_of,
    with_admission,
)
from dueline.schema import ARRIVAL_ORDER, PAYLOAD, US_PER_DAY, HeaderNames, Timing
from dueline.sources.deliveries import committed_deliveries, filed, outgoing, write_kafka
from dueline.streaming import processor
from dueline.streaming.processor import (
    DELIVERED_SCHEMA,
    EXPIRY,
    PENDING_SCHEMA,
    REQUEST_FIELDS,
    HoldUntilDue,
    narrow,
)

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Settings of a session that runs the job. The number of shuffle partitions is fixed by the first
# start of a query, so choose it for the ids expected later on.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Tasks talk to their state over a Unix socket instead of a local port.
    "spark.python.unix.domain.socket.enabled": "true",
}

# What is known of the destinations: a table, measured already, in versions that change, or nothing.
Known = DataFrame | KnownDestinations | DestinationList | None

# The processor travels with the query, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(processor)

# Ids are dealt to so many lanes, the keys of the state. Like the number of shuffle partitions, this is fixed by
# the first start of a query. A lane's pending requests are read and written together, so they should stay few.
LANES = 1 << 16
# Rows that are made of the state at a time.
STATE_ROWS = 10_000

STEP_SCHEMA = f"id string, arrival_tick bigint, {PENDING_SCHEMA}".replace(", timer_ms bigint", "")


def schedule_stream(
    requests: DataFrame,
    timing: Timing = Timing(),
    replay_delay: str | None = None,
    initial_pending: DataFrame | None = None,
    payload: bool = True,
    strict_expiry: bool = False,
    lanes: int = LANES,
) -> DataFrame:
    """Deliveries of a stream of requests.

    By default time is the clock: what is due goes out with the next micro-batch, nothing is ever
    too late. With ``replay_delay``, e.g. "1 minute", time is that of the messages and the result
    is the one of ``delivery_log``; requests may then be out of order by less than this delay.
    ``initial_pending`` starts the query with a ``pending_snapshot`` that has its payload.
    Without ``payload``, requests need no key, value and headers; neither the state nor the result
    has them. ``strict_expiry`` leaves out what has expired by the time it is released, as in
    ``delivery_log``; ``initial_pending`` then needs ``expires_us`` or the expiry of the requests.
    """
    shape = (lambda schema: schema) if payload else narrow
    request_fields = [f for f in REQUEST_FIELDS if payload or f not in PAYLOAD]
    step_schema = shape(STEP_SCHEMA)
    if strict_expiry:
        requests, initial_pending = (with_expiry(df) for df in (requests, initial_pending))
        request_fields, step_schema = [*request_fields, "expires_us"], step_schema + EXPIRY
    replay = replay_delay is not None
    judged = with_admission(requests, timing)
    if not replay:
        # The clock is the grid; a request fires when it is due.
        due = F.greatest(
            instant_to_micros(F.col("scheduled_sec"), F.col("scheduled_nano")), "arrival_us"
        )
        judged = judged.withColumn("fire_at", F.when(F.col("refusal").isNull(), due))
    judged = judged.observe(
        "processed_records",
        F.count(F.lit(1)).alias("valid"),
        F.count_if(F.col("refusal").isNull()).alias("scheduled"),
    )
    steps = judged.select("id", "arrival_tick", *request_fields)
    # Before the shuffle: a busy id sends on one row per Arrow batch (and tick), not all. By the
    # clock the last request of a partition is the one with the highest offset, whatever its time.
    if replay:
        keep_last = _last_of_each(["id", "arrival_tick"], ARRIVAL_ORDER)
    else:
        keep_last = _last_of_each(["id", "topic", "partition"], ["offset"])
    lane = F.pmod(F.xxhash64("id"), F.lit(lanes)).alias("lane")
    names = processor.request_names(request_fields)
    steps = steps.mapInArrow(keep_last, step_schema).select(lane, "*")
    steps = steps.mapInArrow(_as_binary(names), "lane bigint, arrival_us bigint, request binary")
    initial = None
    if initial_pending is not None:
        # One row for each lane, as the processor is called for each row.
        held = initial_pending.select(lane, "id", *request_fields)
        held = held.mapInArrow(_as_binary(names), "lane bigint, arrival_us bigint, request binary")
        initial = held.groupBy("lane").agg(F.collect_list("request").alias("requests")).groupBy("lane")
    if replay:
        steps = steps.withColumn("event_time", F.timestamp_micros("arrival_us"))
        steps = steps.withWatermark("event_time", replay_delay)
    delivered = (
        steps.drop("arrival_us")
        .groupBy("lane")
        .transformWithState(
            HoldUntilDue(replay, payload, strict_expiry, binary=True),
            "delivered_at bigint, request binary",
            "append",
            "eventTime" if replay else "processingTime",
            initialState=initial,
        )
    )
    schema = StructType.fromDDL(shape(DELIVERED_SCHEMA))
    return delivered.mapInArrow(_as_columns(names, schema), schema).observe(
        "forwarded_records", F.count(F.lit(1)).alias("forwarded")
    )


def _as_binary(names: list[str]):
    """For mapInArrow: each request as one binary, beside its lane and arrival."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column("lane"), batch.column("arrival_us"), processor.pack_requests(batch, names)]
            yield pa.RecordBatch.from_arrays(columns, names=["lane", "arrival_us", "request"])

    return pack


def _as_columns(names: list[str], schema: StructType):
    """For mapInArrow: the columns of released requests."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                values = processor.unpack_requests(processor.listed(batch.column("request")), names)
                values["delivered_at"] = batch.column("delivered_at")
                columns = [pa.array(values[f.name], f.type) for f in types]
                yield pa.RecordBatch.from_arrays(columns, schema=types)

    return unpack


def with_expiry(df: DataFrame | None) -> DataFrame | None:
    """The rows with ``expires_us``: later than a microsecond if and only if the expiry is."""
    if df is None or "expires_us" in df.columns:
        return df
    return df.withColumn("expires_us", instant_to_micros(F.col("expires_sec"), F.col("expires_nano")))


def still_due(pending: DataFrame) -> DataFrame:
    """What a query holds, as it leaves at its own tick when no message comes any more."""
    due = pending.withColumn("delivered_at", F.col("fire_at"))
    return due.where("expires_us > fire_at").drop("expires_us") if "expires_us" in due.columns else due


def _last_of_each(same: list[str], by: list[str]):
    """For mapInArrow: keep the last row, in the given order, of each group within a batch."""

    def keep_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.select(list(dict.fromkeys([*same, *by]))).to_pandas()
            order = order.sort_values(by, kind="stable")
            last = order.drop_duplicates(same, keep="last").index.sort_values()
            yield batch.take(pa.array(last, pa.int64()))

    return keep_last


@dataclass(frozen=True)
class FileSink:
    """Where a job keeps its tables. All of it must be shared storage on a cluster."""

    root: str

    @property
    def intake(self) -> str:
        return f"{self.root}/intake"

    @property
    def deliveries(self) -> str:
        return f"{self.root}/deliveries"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def requests(self) -> str:
        return f"{self.root}/requests"

    def checkpoint(self, query: str) -> str:
        return f"{self.root}/checkpoints/{query}"


def start_file_delivery(
    deliveries: DataFrame,
    sink: FileSink,
    known: Known = None,
    interval: str | None = "1 second",
    names: HeaderNames = HeaderNames(),
) -> StreamingQuery:
    """Write a delivery stream as files by destination; ``known`` is false in dead letters.

    Every micro-batch with deliveries is one commit (see ``CommittedTable``): one that is run again
    after a failure leaves no row twice, and a half written one is not seen. ``interval=None`` runs
    until the input at hand is used up; it is for replays, as a query by the clock never runs out of
    ticks. A ``DestinationList`` is looked at in each micro-batch, so new topics work at once.
    """

    known, table = measured_known(known), committed_deliveries(sink.deliveries)

    def write(batch: DataFrame, batch_id: int) -> None:
        # The rows are still spread by id, as the state is; each task writes its own in order.
        rows = filed(batch, names, current_known(known, batch.sparkSession))
        table.append(rows.sortWithinPartitions("to", *RELEASE_ORDER), batch_id)

    writer = deliveries.writeStream.foreachBatch(write).option(
        "checkpointLocation", sink.checkpoint("deliveries")
    )
    return start_writer(writer, interval)


def start_kafka_delivery(
    deliveries: DataFrame,
    servers: str,
    checkpoint: str,
    known: Known = None,
    dead_letter_topic: str | None = None,
    interval: str = "1 second",
    names: HeaderNames = HeaderNames(),
) -> StreamingQuery:
    """Send a delivery stream to Kafka, each message to its own topic.

    Any sink error but an unknown destination fails the micro-batch, which is then tried again.
    Without ``known`` all destinations are taken to exist, so an unknown one is such an error too.
    """

    known = measured_known(known)

    def send(batch: DataFrame, batch_id: int) -> None:
        write_kafka(outgoing(batch, names, current_known(known, batch.sparkSession), dead_letter_topic), servers)

    writer = deliveries.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return start_writer(writer, interval)


def start_quarantine(
    messages: DataFrame,
    sink: FileSink,
    interval: str | None = "1 minute",
    names: HeaderNames = HeaderNames(),
) -> StreamingQuery:
    """Keep the messages that are no request, beside the main query."""
    bad = quarantine_of(parse_messages(messages, names), names)
    return _start_append(bad, sink.quarantine, sink.checkpoint("quarantine"), interval)


def start_request_log(
    messages: DataFrame,
    sink: FileSink,
    interval: str | None = "1 minute",
    names: HeaderNames = HeaderNames(),
) -> StreamingQuery:
    """Keep every request, for replays and snapshots as of any instant, in a directory per day (UTC)
    of its arrival: a snapshot opens only the days that it needs."""
    requests = requests_of(parse_messages(messages, names), names)
    day = arrival_day(F.col("arrival_us"))
    requests = requests.withColumn("day", day)
    return _start_append(requests, sink.requests, sink.checkpoint("requests"), interval, "day")


def arrival_day(us: Column) -> Column:
    """The number of an instant's day, in microseconds from the epoch, whatever the time zone."""
    into_day = F.pmod(us, F.lit(US_PER_DAY))
    return F.call_function("div", us - into_day, F.lit(US_PER_DAY)).cast("int")


def read_request_log(
    spark: SparkSession, sink: FileSink, from_us: int | None = None, to_us: int | None = None
) -> DataFrame:
    """Requests that arrived between two instants (both included); only their days are read."""
    log = spark.read.parquet(sink.requests)
    if from_us is not None:
        log = log.filter((F.col("day") >= from_us // US_PER_DAY) & (F.col("arrival_us") >= from_us))
    if to_us is not None:
        log = log.filter((F.col("day") <= to_us // US_PER_DAY) & (F.col("arrival_us") <= to_us))
    return log.drop("day")


def pending_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a running or stopped query holds, read from its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "pending").load(checkpoint)
    return requests_of_lanes(state.select("value.*"))


def requests_of_lanes(lanes: DataFrame) -> DataFrame:
    """The id and request in each lane's value (columns held and shape), beside the other columns."""
    others = [f for f in lanes.schema.fields if f.name not in ("timer_ms", "held", "shape")]
    fields = lanes.schema["shape"].dataType.fields
    schema = StructType([*others, StructField("id", StringType()), *fields])
    first, names = len(others), processor.request_names([f.name for f in fields])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        for batch in batches:
            places: list[int] = []
            timers: list[int] = []
            requests: list[bytes] = []
            for i, held in enumerate(processor.listed(batch.column(first))):
                for timer, request in processor.unpacked(held).values():
                    places.append(i)
                    timers.append(timer)
                    requests.append(request)
                if requests and (len(requests) >= STATE_ROWS or i == batch.num_rows - 1):
                    values = {**processor.unpack_requests(requests, names), "timer_ms": timers}
                    columns = [batch.column(k).take(pa.array(places, pa.int64())) for k in range(first)]
                    columns += [pa.array(values[f.name], f.type) for f in list(types)[first:]]
                    yield pa.RecordBatch.from_arrays(columns, schema=types)
                    places, timers, requests = [], [], []

    return lanes.select(*[f.name for f in others], "held").mapInArrow(rows_of, schema)


def measured_known(known: Known) -> KnownDestinations | DestinationList | None:
    """The size of a plain table of destinations is looked at when a query starts, not in every micro-batch."""
    return known_destinations(known) if isinstance(known, DataFrame) else known


def current_known(known: KnownDestinations | DestinationList | None, spark: SparkSession) -> KnownDestinations | None:
    return known.current(spark) if isinstance(known, DestinationList) else known


def _start_append(
    rows: DataFrame, path: str, checkpoint: str, interval: str | None, directories: str | None = None
) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if directories is not None:
        writer = writer.partitionBy(directories)
    return start_writer(writer.option("path", path), interval)


def start_writer(writer, interval: str | None) -> StreamingQuery:
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
