"""What a query's state has been through, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dueline.schema import ARRIVAL_ORDER, MESSAGE_ID
from dueline.streaming.job import requests_of_lanes


def state_history(
    spark: SparkSession,
    checkpoint: str,
    delivered: DataFrame,
    from_batch: int = 0,
    to_batch: int | None = None,
) -> DataFrame:
    """id, batch, change, topic, partition, offset, by_offset: a row for each time that a request of the id
    came into the state (``held``), was ``replaced`` (by the request at ``by_offset``), was ``released`` or
    was ``cancelled``, in the micro-batches asked for.

    It is read from the change feed of the state store, which reaches as far back as the store keeps its
    files. What leaves the state was released if it is among ``delivered`` (by message id), else cancelled.
    In a micro-batch an id takes its new request first and releases after it, so a request may be held and
    released in one. A window holds the changes of one id, at most one for each micro-batch.
    """
    reader = spark.read.format("statestore").option("stateVarName", "pending")
    feed = reader.option("readChangeFeed", "true").option("changeStartBatchId", from_batch)
    if to_batch is not None:
        feed = feed.option("changeEndBatchId", to_batch)
    feed = feed.load(checkpoint).select("batch_id", F.col("key.lane").alias("lane"), "value.*")
    if from_batch > 0:
        held = spark.read.format("statestore").option("stateVarName", "pending").option("batchId", from_batch - 1).load(checkpoint)
        before = F.lit(from_batch - 1).cast("bigint").alias("batch_id")
        feed = feed.unionByName(held.select(before, F.col("key.lane").alias("lane"), "value.*"))
    # A lane is written once or twice in a micro-batch: with what came, and without what left.
    order = Window.partitionBy("lane").orderBy("batch")
    writes = feed.groupBy("lane", F.col("batch_id").alias("batch")).agg(F.count(F.lit(1)).alias("writes"))
    writes = writes.withColumn("next_write", F.lead("batch").over(order))
    request = F.struct(*[F.col(c) for c in [*ARRIVAL_ORDER, "fire_at"]])
    seen = requests_of_lanes(feed.where(F.col("held").isNotNull())).groupBy("lane", "id", F.col("batch_id").alias("batch"))
    seen = seen.agg(F.max(request).alias("put"), F.count(F.lit(1)).alias("times")).join(writes, ["lane", "batch"])
    ids = Window.partitionBy("id").orderBy("batch")
    seen = seen.withColumns({"gone": (F.col("times") < F.col("writes")).cast("int"), "next_seen": F.lead("batch").over(ids)})
    # What was held and is not there when its lane is written again has gone then.
    missing = (F.col("gone") == 0) & F.col("next_write").isNotNull() & ~F.col("next_seen").eqNullSafe(F.col("next_write"))
    lost = seen.where(missing).select("id", F.col("next_write").alias("batch"), F.lit(None).cast(seen.schema["put"].dataType).alias("put"), F.lit(1).alias("gone"))
    steps = seen.select("id", "batch", "put", "gone").unionByName(lost)
    after = F.when(F.col("gone") == 0, F.col("put"))
    steps = steps.withColumn("before", F.lag(after).over(ids)).where(F.col("batch") >= from_batch)
    # What is written again as it was has not come anew.
    put, before = F.when(~F.col("put").eqNullSafe(F.col("before")), F.col("put")), F.col("before")
    none = F.lit(None).cast("bigint")

    def row(change: str, request: Column, by: Column = none) -> Column:
        return F.struct(F.lit(change).alias("change"), *[request[c].alias(c) for c in MESSAGE_ID], by.alias("by_offset"))

    rows = F.array(
        F.when(put.isNotNull() & before.isNull(), row("held", put)),
        F.when(put.isNotNull() & before.isNotNull(), row("replaced", before, put["offset"])),
        F.when((F.col("gone") == 1) & F.coalesce(put, before).isNotNull(), row("left", F.coalesce(put, before))),
    )
    changes = steps.select("id", "batch", F.explode(F.array_compact(rows)).alias("r")).select("id", "batch", "r.*")
    sent = delivered.select(*MESSAGE_ID).distinct().withColumn("sent", F.lit(True))
    how = F.when(F.col("sent"), "released").otherwise("cancelled")
    return (
        changes.join(sent, MESSAGE_ID, "left")
        .withColumn("change", F.when(F.col("change") == "left", how).otherwise(F.col("change")))
        .select("id", "batch", "change", *MESSAGE_ID, "by_offset")
    )
