"""Writing deliveries to their destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.operators import (
    RELEASE_ORDER,
    KnownDestinations,
    mark_known_destinations,
    restore_source,
    route,
)
from dueline.schema import HeaderNames
from dueline.sources.committed import CommittedTable

# Fixed value: what a topic may be called. Other names get no directory of their own.
TOPIC_NAME = r"^[a-zA-Z0-9._-]{1,249}\z"

# The file tables: one directory ``to=<destination>`` per destination that is known and well named.
FILE_SCHEMA = (
    "id string, arrival_us bigint, topic string, partition int, offset bigint, "
    "scheduled_sec bigint, scheduled_nano int, destination string, delivered_at bigint, "
    "key binary, value binary, headers array<struct<key:string,value:binary>>, known boolean"
)


def outgoing(
    deliveries: DataFrame,
    names: HeaderNames = HeaderNames(),
    known: DataFrame | KnownDestinations | None = None,
    dead_letter_topic: str | None = None,
    ranges: bool = False,
) -> DataFrame:
    """Rows for Spark's Kafka sink: ``topic`` says where each one goes, and the sink itself
    partitions by key.

    Each task sends its rows in release order; with ``ranges``, for whole replays, the tasks hold
    ranges of that order. The sort comes last: one before the join with ``known`` would be lost.

    With ``known``, messages for any other destination go to ``dead_letter_topic``, or are dropped
    if there is none.
    """
    routed = route(restore_source(deliveries, names), names)
    topic = F.col("to_topic")
    if known is not None:
        routed = mark_known_destinations(routed, known)
        if dead_letter_topic is None:
            routed = routed.filter(F.col("known"))
        else:
            topic = F.when(F.col("known"), topic).otherwise(F.lit(dead_letter_topic))
    if ranges:
        routed = routed.repartitionByRange(*RELEASE_ORDER)
    ordered = routed.withColumn("_out", topic).sortWithinPartitions(*RELEASE_ORDER)
    return ordered.select(F.col("_out").alias("topic"), "key", "value", "headers")


def filed(
    deliveries: DataFrame,
    names: HeaderNames = HeaderNames(),
    known: DataFrame | KnownDestinations | None = None,
) -> DataFrame:
    """Rows for the file tables: as they leave, with ``known`` and the directory ``to``."""
    if known is None:
        marked = deliveries.withColumn("known", F.lit(True))
    else:
        marked = mark_known_destinations(deliveries, known)
    has_directory = F.col("known") & F.col("destination").rlike(TOPIC_NAME)
    columns = [field.split()[0] for field in FILE_SCHEMA.split(", ")]
    return (
        restore_source(marked, names)
        .withColumn("to", F.when(has_directory, F.col("destination")))
        .select(*columns, "to")
    )


def write_files(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Write rows made by ``filed``: one directory per destination, files in release order.

    The rows are split by ranges of the whole sort key, so a busy destination becomes many files
    and a rare one a single file.
    """
    order = ["to", *RELEASE_ORDER]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode(mode).partitionBy("to").parquet(path)


def committed_deliveries(path: str) -> CommittedTable:
    """The deliveries of a stream: a commit for each micro-batch that released something."""
    return CommittedTable(path, f"{FILE_SCHEMA}, to string", ranged="delivered_at", folders=("to",))


def read_delivered(
    spark: SparkSession,
    path: str,
    batches: bool = False,
    from_us: int | None = None,
    to_us: int | None = None,
) -> DataFrame:
    """Rows written by ``write_files`` or, with ``batches``, committed by the streaming job; those only
    that were delivered between two instants (both included), if they are given.

    The schema is given, so that a destination that looks like a number stays text.
    """
    if batches:
        return committed_deliveries(path).read(spark, from_us, to_us)
    rows = spark.read.schema(f"{FILE_SCHEMA}, to string").parquet(path)
    if from_us is not None:
        rows = rows.filter(F.col("delivered_at") >= from_us)
    return rows if to_us is None else rows.filter(F.col("delivered_at") <= to_us)


def write_kafka(rows: DataFrame, servers: str) -> None:
    """Send rows made by ``outgoing``. Needs Spark's Kafka connector on the class path."""
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
