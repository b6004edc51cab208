"""Reading messages: Kafka topics or Parquet files of the same shape, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dueline.schema import MESSAGE_SCHEMA


def kafka_options(servers: str, topics: list[str], **extra: str) -> dict[str, str]:
    """Options of Spark's Kafka source for one or more input topics, with headers."""
    if not topics:
        raise ValueError("at least one input topic is needed")
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "includeHeaders": "true",
        **extra,
    }


def read_kafka(
    spark: SparkSession, servers: str, topics: list[str], stream: bool = True, **extra: str
) -> DataFrame:
    """Messages of the topics. Needs Spark's Kafka connector on the class path.

    Limit what one micro-batch takes with ``maxOffsetsPerTrigger``.
    """
    reader = spark.readStream if stream else spark.read
    messages = reader.format("kafka").options(**kafka_options(servers, topics, **extra)).load()
    return messages.select(*_columns())


def read_files(
    spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """Messages kept as Parquet files."""
    if not stream:
        return spark.read.schema(MESSAGE_SCHEMA).parquet(path)
    reader = spark.readStream.schema(MESSAGE_SCHEMA)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _columns() -> list[str]:
    return [column.split()[0] for column in MESSAGE_SCHEMA.split(", ")]
