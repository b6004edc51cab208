"""Whole jobs: from messages to what their destinations receive."""

from __future__ import annotations

from collections import Counter, defaultdict
from threading import Event

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from dueline.operators import RELEASE_ORDER, delivery_log, ingest, with_payload, with_stored_payload
from dueline.schema import HeaderNames, Timing
from dueline.sources.deliveries import committed_deliveries, filed, read_delivered, write_files
from dueline.streaming.intake import (
    SLOT_US,
    read_intake,
    start_intake,
    start_narrow_delivery,
    with_logged_payload,
)
from dueline.streaming.job import (
    STREAM_SETTINGS,
    FileSink,
    Known,
    current_known,
    measured_known,
    pending_in_state,
    schedule_stream,
    start_file_delivery,
    still_due,
)


def stream_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one with the settings that streams need."""
    session = spark.newSession()
    # Enough to see the progress of every micro-batch of a bounded run.
    session.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    # A table in many folders is listed by some tasks, not by one for each of its files.
    session.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", "64")
    for name, value in STREAM_SETTINGS.items():
        # Spark has no entry for the options of a state store and calls them not modifiable, but takes them.
        if name.startswith("spark.sql."):
            session.conf.set(name, value)
    return session


def replay_messages(
    messages: DataFrame, timing: Timing = Timing(), names: HeaderNames = HeaderNames()
) -> DataFrame:
    """What a log of raw messages leads to: deliveries with their payload."""
    requests, _ = ingest(messages, names)
    # Payloads come straight from the messages, which saves reading the headers a second time.
    return with_payload(delivery_log(requests, timing), with_stored_payload(messages, names))


def replay_to_files(
    messages: DataFrame,
    path: str,
    timing: Timing = Timing(),
    known: DataFrame | None = None,
    names: HeaderNames = HeaderNames(),
) -> DataFrame:
    """Replay a message log into files by destination, and read them back."""
    write_files(filed(replay_messages(messages, timing, names), names, known), path)
    return read_delivered(messages.sparkSession, path)


def replay_stream_to_files(
    spark: SparkSession,
    messages: DataFrame,
    root: str,
    replay_delay: str,
    timing: Timing = Timing(),
    known: DataFrame | None = None,
    names: HeaderNames = HeaderNames(),
    drain: bool = True,
    strict_expiry: bool = False,
) -> DataFrame:
    """Run a message stream in message time until its input at hand is used up, and read what was
    written: all that is delivered in the end, also what is due after the last message. Without
    ``drain`` that stays in the state, for a later run with more input.

    Fails if the watermark dropped a row, as the result would lack it.
    """
    requests, _ = ingest(messages, names)
    sink = FileSink(root)
    deliveries = schedule_stream(requests, timing, replay_delay, strict_expiry=strict_expiry)
    with DroppedRows(messages.sparkSession) as dropped:
        running = start_file_delivery(deliveries, sink, known, interval=None, names=names)
        running.awaitTermination()
        dropped.fail_if_any(running)
    if drain and any_batch(spark, sink.checkpoint("deliveries")):
        # No message comes any more, so whatever waits in the state goes out at its own tick.
        left = still_due(pending_in_state(spark, sink.checkpoint("deliveries")))
        drained = filed(left, names, known)
        order = ["to", *RELEASE_ORDER]
        # The next micro-batch there would be: a drain that is run again adds nothing.
        last = last_batch(spark, sink.checkpoint("deliveries")) + 1
        ordered = drained.repartitionByRange(*order).sortWithinPartitions(*order)
        committed_deliveries(sink.deliveries).append(ordered, last)
    return read_delivered(spark, sink.deliveries, batches=True)


class DroppedRows(StreamingQueryListener):
    """How many rows the micro-batches of queries left out because they were later than the watermark:
    all micro-batches, whatever number of them a session remembers. A context while it listens."""

    def __init__(self, spark: SparkSession):
        self.streams = spark.streams
        self.rows: Counter[str] = Counter()
        self.ended: defaultdict[str, Event] = defaultdict(Event)

    def __enter__(self) -> DroppedRows:
        self.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.streams.removeListener(self)

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        progress = event.progress
        self.rows[str(progress.runId)] += sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        self.ended[str(event.runId)].set()

    def fail_if_any(self, ended: StreamingQuery, seconds: float = 600) -> None:
        """Raise if a query that has ended dropped rows. Its last events may still be on their way."""
        if not self.ended[str(ended.runId)].wait(seconds):
            raise TimeoutError("the query's end was not reported")
        if dropped := self.rows[str(ended.runId)]:
            raise ValueError(f"{dropped} rows were later than the replay delay and were dropped")


def last_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last micro-batch that a query has finished, by its own log; -1 if none."""
    try:
        log = spark.read.format("binaryFile").load(f"{checkpoint}/commits").select("path")
        return max((int(r.path.rpartition("/")[2]) for r in log.collect() if r.path.rpartition("/")[2].isdigit()), default=-1)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1


def any_batch(spark: SparkSession, checkpoint: str) -> bool:
    return last_batch(spark, checkpoint) >= 0


def stream_to_files(
    spark: SparkSession,
    messages: DataFrame,
    root: str,
    timing: Timing = Timing(),
    known: DataFrame | None = None,
    names: HeaderNames = HeaderNames(),
    strict_expiry: bool = False,
) -> DataFrame:
    """Run a message stream by the clock until a micro-batch neither reads nor releases anything,
    and read what was written. What is not due yet stays in the query's state."""
    requests, _ = ingest(messages, names)
    sink = FileSink(root)
    deliveries = schedule_stream(requests, timing, strict_expiry=strict_expiry)
    running = start_file_delivery(deliveries, sink, known, names=names)
    try:
        wait_until_idle(running)
    finally:
        running.stop()
    return read_delivered(spark, sink.deliveries, batches=True)


def intake_to_tables(
    spark: SparkSession,
    messages: DataFrame,
    root: str,
    timing: Timing = Timing(),
    names: HeaderNames = HeaderNames(),
    slot_us: int = SLOT_US,
) -> FileSink:
    """Read the messages at hand, once, into the intake table; run again, it takes what is new."""
    sink = FileSink(root)
    start_intake(messages, sink, timing, None, names, slot_us).awaitTermination()
    return sink


def deliver_from_intake(
    spark: SparkSession,
    sink: FileSink,
    timing: Timing = Timing(),
    known: Known = None,
    names: HeaderNames = HeaderNames(),
    slot_us: int = SLOT_US,
    strict_expiry: bool = False,
) -> DataFrame:
    """Deliver by the clock what the intake table holds until nothing is left to read or due, and read what
    was written. What is not due yet stays in the query's state, without its payload."""
    running = start_narrow_delivery(spark, sink, timing, known, names=names, slot_us=slot_us, strict_expiry=strict_expiry)
    try:
        wait_until_idle(running)
    finally:
        running.stop()
    return read_delivered(spark, sink.deliveries, batches=True)


def replay_from_intake(
    spark: SparkSession,
    sink: FileSink,
    replay_delay: str,
    timing: Timing = Timing(),
    known: Known = None,
    names: HeaderNames = HeaderNames(),
    slot_us: int = SLOT_US,
    initial_pending: DataFrame | None = None,
    cut: DataFrame | None = None,
    out: FileSink | None = None,
    drain: bool = True,
    strict_expiry: bool = False,
) -> DataFrame:
    """The same in message time, with all that is due after the last message; see
    ``replay_stream_to_files``. A query that takes another's place is started as in
    ``start_narrow_delivery``."""
    out = out or sink
    with DroppedRows(spark) as dropped:
        running = start_narrow_delivery(spark, sink, timing, known, None, names, replay_delay, slot_us, initial_pending, cut, out, strict_expiry)
        running.awaitTermination()
        dropped.fail_if_any(running)
    checkpoint = out.checkpoint("deliveries")
    if drain and any_batch(spark, checkpoint):
        left = still_due(pending_in_state(spark, checkpoint))
        full = with_logged_payload(left, read_intake(spark, sink), slot_us)
        order = ["to", *RELEASE_ORDER]
        rows = filed(full, names, current_known(measured_known(known), spark)).repartitionByRange(*order)
        committed_deliveries(out.deliveries).append(rows.sortWithinPartitions(*order), last_batch(spark, checkpoint) + 1)
    return read_delivered(spark, out.deliveries, batches=True)


def wait_until_idle(running: StreamingQuery, after: int = -1) -> None:
    """Until a micro-batch behind ``after`` has nothing to read and nothing to release, however long that
    takes; or until the source has been asked and there is nothing for a first one."""
    first = None
    while not running.awaitTermination(1):
        last, status = running.lastProgress, running.status
        if last is None:
            if status["message"].startswith("Waiting for") and not status["isDataAvailable"]:
                return
            continue
        # The first batch may be one that an earlier run began: what has come since is in the next.
        first = first or last
        fresh = last.batchId > max(after, first.batchId) or (last.batchId == first.batchId > after and last.timestamp != first.timestamp)
        forwarded = last.observedMetrics.get("forwarded_records")
        if fresh and last.numInputRows == 0 and (forwarded is None or forwarded["forwarded"] == 0):
            return
