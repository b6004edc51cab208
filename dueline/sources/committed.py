"""Tables that streams write commit by commit: only what a commit record names is there.

A micro-batch writes its rows into the folder of the next commit, and then a record with that folder's
number, the micro-batch and the rows' count and range. The record is one small file that Spark moves into
place as a whole, so a batch is either there or not. A batch that failed before its record left rows in a
folder that no record names; the next commit overwrites it. A batch that is run again after its record was
written writes nothing. A batch without rows writes no record, so ticks in which nothing happens leave one
folder at most, whatever their number. Readers open the folders that records name, and no others.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COMMIT_SCHEMA = "number bigint, batch bigint, rows bigint, low bigint, high bigint"


class CommittedTable:
    """One writer at a time; any number of readers. ``ranged`` names a column of bigints whose range is
    kept for each commit, so that readers can leave commits out; ``folders`` are partition columns."""

    def __init__(self, path: str, schema: str, ranged: str | None = None, folders: tuple[str, ...] = ()):
        self.path, self.schema, self.ranged, self.folders = path, schema, ranged, folders
        self._last: tuple[int, int] | None = None

    def commits(self, spark: SparkSession) -> DataFrame:
        """number, batch, rows, low, high: a row for each commit."""
        try:
            return spark.read.schema(COMMIT_SCHEMA).parquet(f"{self.path}/commits/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], COMMIT_SCHEMA)  # nothing was committed so far

    def last(self, spark: SparkSession) -> tuple[int, int]:
        """Number and batch of the last commit; (-1, -1) if there is none."""
        row = self.commits(spark).agg(F.max("number"), F.max("batch")).first()
        return (-1, -1) if row[0] is None else (row[0], row[1])

    def append(self, rows: DataFrame, batch: int | None = None) -> int:
        """Write rows as one commit, in the order they have within partitions; returns how many.

        ``batch`` is the micro-batch, by which one that is run again is known; without it, the rows count
        as the batch after the last one.
        """
        spark = rows.sparkSession
        if self._last is None:
            self._last = self.last(spark)
        number, before = self._last
        batch = before + 1 if batch is None else batch
        if batch <= before:
            # It is in the table. The rows are still asked for, as a query's state follows from them.
            rows.write.format("noop").mode("overwrite").save()
            return 0
        number += 1
        seen = Observation()
        value = F.col(self.ranged) if self.ranged else F.lit(None).cast("bigint")
        counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(value).alias("low"), F.max(value).alias("high"))
        counted.write.mode("overwrite").partitionBy(*self.folders).parquet(self.folder(number))
        found = seen.get
        if found["rows"]:
            record = spark.createDataFrame([(number, batch, found["rows"], found["low"], found["high"])], COMMIT_SCHEMA)
            record.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{number:020d}")
            self._last = (number, batch)
        return found["rows"]

    def folder(self, number: int) -> str:
        return f"{self.path}/data/commit={number}"

    def read(self, spark: SparkSession, low: int | None = None, high: int | None = None) -> DataFrame:
        """All committed rows, with their ``commit``; with bounds, both included, only rows in them."""
        commits = self.commits(spark)
        if low is not None:
            commits = commits.where(F.col("high") >= low)
        if high is not None:
            commits = commits.where(F.col("low") <= high)
        rows = self.read_commits(spark, [r.number for r in commits.select("number").collect()])
        if low is not None:
            rows = rows.where(F.col(self.ranged) >= low)
        return rows if high is None else rows.where(F.col(self.ranged) <= high)

    def read_commits(self, spark: SparkSession, numbers: list[int]) -> DataFrame:
        """The rows of some commits. The schema is given, so that text that looks like a number stays text."""
        schema = f"{self.schema}, commit bigint"
        if not numbers:
            return spark.createDataFrame([], schema)
        reader = spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*map(self.folder, sorted(numbers)))
