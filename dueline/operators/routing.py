"""From deliveries back to messages for their destinations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.functions import append_header, last_header
from dueline.schema import MESSAGE_ID, HeaderNames
from dueline.sources.committed import CommittedTable

# A list of destinations up to this many bytes is broadcast; a name counts 40 bytes more than it has.
BROADCAST_BYTES = 32 << 20
NAME_OVERHEAD = 40
# Beyond it both sides are shuffled, with each destination spread over this many keys.
SALTS = 64


def restore_source(deliveries: DataFrame, names: HeaderNames = HeaderNames()) -> DataFrame:
    """Give a delivery its outgoing headers: the message's own, then its destination."""
    return deliveries.withColumn(
        "headers", append_header(F.col("headers"), names.destination, F.col("destination"))
    )


def route(messages: DataFrame, names: HeaderNames = HeaderNames()) -> DataFrame:
    """Add ``to_topic``, named by the last destination header; null without one."""
    destination = last_header(F.col("headers"), names.destination)
    return messages.withColumn("to_topic", F.make_valid_utf8(destination.cast("string")))


@dataclass(frozen=True)
class KnownDestinations:
    """The names that exist (column ``destination``), and whether they are few enough to broadcast."""

    names: DataFrame
    few: bool


def known_destinations(known: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> KnownDestinations:
    """Measure a table of destinations once, so that a stream need not do it in every micro-batch."""
    names = known.select("destination").where(F.col("destination").isNotNull()).distinct()
    size = names.agg(F.sum(F.octet_length("destination") + NAME_OVERHEAD)).first()[0]
    return KnownDestinations(names, (size or 0) <= broadcast_bytes)


class DestinationList:
    """The destinations that exist, in versions: a running stream looks at the version in each micro-batch
    and reads the names again only when it has moved. A version is one commit, so a half written one is
    never seen. Before the first version, no destination exists."""

    def __init__(self, path: str, broadcast_bytes: int = BROADCAST_BYTES):
        self.table = CommittedTable(path, "destination string")
        self.broadcast_bytes = broadcast_bytes
        self._seen: tuple[int, KnownDestinations] | None = None

    def publish(self, names: DataFrame) -> None:
        """Make the column ``destination`` of a table the new version."""
        self.table.append(names.select("destination").where(F.col("destination").isNotNull()).distinct())

    def current(self, spark: SparkSession) -> KnownDestinations:
        version = self.table.last(spark)[0]
        if self._seen is None or self._seen[0] != version:
            names = self.table.read_commits(spark, [version] if version >= 0 else [])
            self._seen = (version, known_destinations(names, self.broadcast_bytes))
        return self._seen[1]


def mark_known_destinations(
    deliveries: DataFrame, known: DataFrame | KnownDestinations, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Add ``known``: is the destination in the table ``known`` (column ``destination``)?

    A null destination is unknown. One busy destination does not end up in one task: the names are
    broadcast if their bytes are few, which is checked, and joined on salted keys if not.
    """
    if not isinstance(known, KnownDestinations):
        known = known_destinations(known, broadcast_bytes)
    names = known.names.select(F.col("destination").alias("_name"), F.lit(True).alias("_found"))
    same = F.col("destination") == F.col("_name")
    if known.few:
        names = F.broadcast(names)
    else:
        names = names.withColumn("_name_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        deliveries = deliveries.withColumn("_salt", message_lane(SALTS))
        same = same & (F.col("_salt") == F.col("_name_salt"))
    return (
        deliveries.join(names, same, "left")
        .withColumn("known", F.coalesce(F.col("_found"), F.lit(False)))
        .drop("_name", "_found", "_salt", "_name_salt")
    )


def split_unknown_destinations(
    deliveries: DataFrame, known: DataFrame | KnownDestinations, broadcast_bytes: int = BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Deliveries whose destination exists, and the rest, for a dead-letter table. Two frames over one
    input: what reads both should use ``mark_known_destinations``, which reads it once."""
    marked = mark_known_destinations(deliveries, known, broadcast_bytes)
    return (
        marked.filter(F.col("known")).drop("known"),
        marked.filter(~F.col("known")).drop("known"),
    )


def message_lane(lanes: int) -> Column:
    """An even spread of messages over ``lanes`` numbers, the same one whenever it is computed."""
    return F.pmod(F.xxhash64(*MESSAGE_ID), F.lit(lanes)).cast("int")
