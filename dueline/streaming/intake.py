"""One read of the messages for all tables, and a delivery stream whose state holds no payload.

The intake query reads and parses each message once and appends it, by Spark's file sink, to one table in
folders by ``kind`` (request or quarantine), ``day`` of arrival and ``slot``, the stretch of time in which a
request is due. That sink lists its files by micro-batch, so a batch that is run again or cut off leaves no row
twice or by halves, and every reader follows the list. The request log and the quarantine are this table's
folders: a snapshot opens the days that it needs, a release the slots.

The delivery query reads that table instead of the messages: ids, positions and times only, which is all that
its state keeps. What a micro-batch releases is joined with its payload by slot and message id; other slots
are not opened. So payload is parsed and written once, read when it is due, and never in Python or in state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dueline.functions import instant_to_micros
from dueline.operators import RELEASE_ORDER, after_cut, parse_messages, with_admission, with_error_header, with_stored_payload
from dueline.schema import MESSAGE_ID, PAYLOAD, REQUEST_COLUMNS, REQUEST_SCHEMA, US_PER_HOUR, HeaderNames, Timing
from dueline.sources.deliveries import committed_deliveries, filed
from dueline.streaming.job import FileSink, Known, arrival_day, current_known, measured_known, schedule_stream, start_writer

# One table for both kinds: requests have no timestamp, reason and detail, the others no metadata.
INTAKE_SCHEMA = f"{REQUEST_SCHEMA}, refusal string, timestamp timestamp, reason string, detail string, kind string, day int, slot bigint"
FOLDERS = ["kind", "day", "slot"]
REQUEST, QUARANTINE = "request", "quarantine"
#: A slot: short ones are opened for less, long ones make fewer files.
SLOT_US = US_PER_HOUR


def due_slot(slot_us: int) -> Column:
    """The slot in which a request is due, from its scheduled time and arrival; it needs no other setting."""
    due = F.greatest(instant_to_micros(F.col("scheduled_sec"), F.col("scheduled_nano")), F.col("arrival_us"))
    return F.call_function("div", due - F.pmod(due, F.lit(slot_us)), F.lit(slot_us))


def intake_rows(messages: DataFrame, timing: Timing = Timing(), names: HeaderNames = HeaderNames(), slot_us: int = SLOT_US) -> DataFrame:
    """Every message, parsed once, as a row of the intake table. Slots of refused requests are null: they are
    never due."""
    judged = with_admission(parse_messages(messages, names), timing)
    bad = F.col("reason").isNotNull()
    as_came = F.struct("key", "value", with_error_header(F.col("headers"), F.col("reason"), names).alias("headers"))
    rows = judged.withColumn("_came", F.when(bad, as_came))
    rows = with_stored_payload(rows, names)
    kept = {c: F.when(bad, F.col(f"_came.{c}")).otherwise(F.col(c)) for c in PAYLOAD}
    rows = rows.withColumns(
        {
            **kept,
            "refusal": F.when(~bad, F.col("refusal")),
            "timestamp": F.when(bad, F.col("timestamp")),
            "detail": F.when(bad, F.col("metadata_reject")),
            "kind": F.when(bad, QUARANTINE).otherwise(REQUEST),
            "day": arrival_day(F.col("arrival_us")),
            "slot": F.when(~bad & F.col("refusal").isNull(), due_slot(slot_us)),
        }
    )
    return rows.select(*[field.split()[0] for field in INTAKE_SCHEMA.split(", ")])


def start_intake(
    messages: DataFrame,
    sink: FileSink,
    timing: Timing = Timing(),
    interval: str | None = "10 seconds",
    names: HeaderNames = HeaderNames(),
    slot_us: int = SLOT_US,
) -> StreamingQuery:
    """Read the messages of a stream, once, into the intake table."""
    rows = intake_rows(messages, timing, names, slot_us)
    writer = rows.writeStream.format("parquet").partitionBy(*FOLDERS).option("path", sink.intake)
    return start_writer(writer.option("checkpointLocation", sink.checkpoint("intake")), interval)


def read_intake(spark: SparkSession, sink: FileSink, stream: bool = False) -> DataFrame:
    """The intake table as it is, or as a stream. It is there once ``start_intake`` was called."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(INTAKE_SCHEMA).parquet(sink.intake)


def requests_in(intake: DataFrame) -> DataFrame:
    """The request log: what ``requests_of`` gives, with the folders ``day`` and ``slot``."""
    return intake.where(F.col("kind") == REQUEST).select(*REQUEST_COLUMNS, "day", "slot")


def quarantine_in(intake: DataFrame) -> DataFrame:
    """What ``quarantine_of`` gives."""
    return intake.where(F.col("kind") == QUARANTINE).select(*MESSAGE_ID, "timestamp", *PAYLOAD, "reason", "detail")


def narrow_requests(spark: SparkSession, sink: FileSink) -> DataFrame:
    """The stream of requests without payload, from the intake table."""
    log = requests_in(read_intake(spark, sink, stream=True))
    return log.select(*[c for c in REQUEST_COLUMNS if c not in PAYLOAD])


def with_logged_payload(released: DataFrame, intake: DataFrame, slot_us: int = SLOT_US) -> DataFrame:
    """Narrow rows with the payload of their request. ``released`` is looked at twice.

    The slots are few, as what is released together is due together; they are read from the rows, so that
    only these folders of the table are opened, and the join is within them."""
    slotted = released.withColumn("slot", due_slot(slot_us))
    slots = [r.slot for r in slotted.select("slot").distinct().collect()]
    payload = intake.where((F.col("kind") == REQUEST) & F.col("slot").isin(slots)).select("slot", *MESSAGE_ID, *PAYLOAD)
    return slotted.join(payload, ["slot", *MESSAGE_ID]).drop("slot")


def start_narrow_delivery(
    spark: SparkSession,
    sink: FileSink,
    timing: Timing = Timing(),
    known: Known = None,
    interval: str | None = "1 second",
    names: HeaderNames = HeaderNames(),
    replay_delay: str | None = None,
    slot_us: int = SLOT_US,
    initial_pending: DataFrame | None = None,
    cut: DataFrame | None = None,
    out: FileSink | None = None,
    strict_expiry: bool = False,
) -> StreamingQuery:
    """Deliver what is due from the intake table; ``slot_us`` as it was written with.

    The result is that of ``start_file_delivery`` over the messages, which it commits in the same way.
    A query that takes the place of another, for example with another number of shuffle partitions, starts
    with what that one held when it was stopped (``pending_in_state``) and behind the ``cut`` of what it had
    read, and keeps its checkpoint and deliveries in a place of its own, ``out``."""
    requests = narrow_requests(spark, sink)
    if cut is not None:
        requests = after_cut(requests, cut)
    deliveries = schedule_stream(requests, timing, replay_delay, initial_pending, payload=False, strict_expiry=strict_expiry)
    out = out or sink
    known, table = measured_known(known), committed_deliveries(out.deliveries)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        released = batch.persist()
        try:
            if not released.count():
                return
            rows = with_logged_payload(released, read_intake(session, sink), slot_us)
            rows = filed(rows, names, current_known(known, session))
            table.append(rows.sortWithinPartitions("to", *RELEASE_ORDER), batch_id)
        finally:
            released.unpersist()

    writer = deliveries.writeStream.foreachBatch(write)
    return start_writer(writer.option("checkpointLocation", out.checkpoint("deliveries")), interval)
