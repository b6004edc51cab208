"""The request log laid out by id, for replays: once shuffled and stored so, it is not shuffled again.

A compaction writes a new version: a table in buckets by id, sorted by arrival, and beside it the requests
of busy ids, which one bucket could not hold, split by ranges of id and arrival. A record names the version
(see ``CommittedTable``), so readers have the old one or the new one, never a half. A replay of the buckets
needs no exchange before its look-ahead; busy ids are reduced first, as in any replay.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dueline.operators import delivery_log, find_busy_ids
from dueline.schema import ARRIVAL_ORDER, REQUEST_COLUMNS, REQUEST_SCHEMA, Timing
from dueline.sources.committed import CommittedTable

VERSION_SCHEMA = "folder string, buckets int, requests bigint, busy_ids array<string>"
SORTED = ["id", *ARRIVAL_ORDER]


@dataclass(frozen=True)
class LogById:
    """A version: requests by bucket, and those of the busy ids."""

    bucketed: DataFrame
    busy: DataFrame
    busy_ids: list[str]

    def requests(self) -> DataFrame:
        return self.bucketed.unionByName(self.busy)

    def delivery_log(self, timing: Timing = Timing(), **options: bool) -> DataFrame:
        """``delivery_log`` of all requests: ids are in one of the two parts, so each part is replayed alone."""
        return delivery_log(self.bucketed, timing, busy_ids=[], **options).unionByName(delivery_log(self.busy, timing, **options))


class RequestLogById:
    """Versions of the log below a shared folder."""

    def __init__(self, path: str):
        self.path = path
        self.versions = CommittedTable(f"{path}/versions", VERSION_SCHEMA)

    def compact(self, requests: DataFrame, buckets: int, busy_at_least: int = 1_000_000) -> int:
        """Make these requests the new version, and return how many they are. A bucket should fit a task."""
        spark = requests.sparkSession
        requests = requests.select(*REQUEST_COLUMNS)
        busy_ids = find_busy_ids(requests, busy_at_least)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        busy = F.coalesce(F.col("id").isin(busy_ids), F.lit(False)) if busy_ids else F.lit(False)
        # As many tasks as buckets, by the same hash: one file for each bucket.
        rows = requests.filter(~busy).repartition(buckets, "id")
        name = _table_name(folder)
        rows.write.bucketBy(buckets, "id").sortBy(*SORTED).option("path", f"{folder}/bucketed").saveAsTable(name)
        apart = requests.filter(busy).repartitionByRange(*SORTED).sortWithinPartitions(*SORTED)
        apart.write.parquet(f"{folder}/busy")
        # Counts come from the files' footers.
        stored = spark.table(name).count() + spark.read.schema(requests.schema).parquet(f"{folder}/busy").count()
        self.versions.append(spark.createDataFrame([(folder, buckets, stored, busy_ids)], VERSION_SCHEMA))
        return stored

    def read(self, spark: SparkSession) -> LogById | None:
        """The version of now; None before the first."""
        number, _ = CommittedTable(self.versions.path, VERSION_SCHEMA).last(spark)
        if number < 0:
            return None
        version = self.versions.read_commits(spark, [number]).first()
        busy = spark.read.schema(REQUEST_SCHEMA).parquet(f"{version.folder}/busy")
        return LogById(_bucketed(spark, version.folder, version.buckets), busy, list(version.busy_ids))


def _bucketed(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """The table of a version. A session that did not write it is told of its files and buckets first."""
    name = _table_name(folder)
    if not spark.catalog.tableExists(name):
        columns = REQUEST_SCHEMA.replace("offset ", "`offset` ")
        spark.sql(
            f"create table if not exists {name} ({columns}) using parquet clustered by (id) "
            f"sorted by ({', '.join(f'`{c}`' for c in SORTED)}) into {buckets} buckets location '{folder}/bucketed'"
        )
    return spark.table(name)


def _table_name(folder: str) -> str:
    return f"request_log_{folder.rpartition('/')[2]}"
