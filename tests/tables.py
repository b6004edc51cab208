"""Small tables for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dueline.schema import INSTANT_MAX, INSTANT_MIN, MESSAGE_SCHEMA
from tests.model import Request

REQUEST_SCHEMA = (
    "arrival_us bigint, topic string, partition int, offset bigint, scheduled_sec bigint, "
    "scheduled_nano int, expires_sec bigint, expires_nano int, created_sec bigint, "
    "created_nano int, id string, destination string, key binary, value binary, "
    "headers array<struct<key:string,value:binary>>"
)


def request_table(spark: SparkSession, requests: list[Request]) -> DataFrame:
    rows = [
        (
            r.arrival_us,
            "in",
            0,
            r.offset,
            r.scheduled_us // 1_000_000,
            r.scheduled_us % 1_000_000 * 1000,
            r.expires_us // 1_000_000,
            r.expires_us % 1_000_000 * 1000,
            *INSTANT_MIN,
            r.id,
            r.destination,
            b"k",
            str(r.offset).encode(),
            [],
        )
        for r in requests
    ]
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def message_table(spark: SparkSession, messages: list[dict]) -> DataFrame:
    """Messages from dicts with headers and, where they matter, key, value, timestamp_us."""
    rows = [
        (
            m.get("key", b"lane-4"),
            m.get("value", b"parcel"),
            "in",
            0,
            m.get("offset", i),
            m["headers"],
            m.get("timestamp_us", 0),
        )
        for i, m in enumerate(messages)
    ]
    schema = (
        "key binary, value binary, topic string, partition int, offset bigint, "
        "headers array<struct<key:string,value:binary>>, us bigint"
    )
    columns = [column.split()[0] for column in MESSAGE_SCHEMA.split(", ")]
    return spark.createDataFrame(rows, schema).selectExpr(
        *[c if c != "timestamp" else "timestamp_micros(us) as timestamp" for c in columns]
    )


def binary_metadata(
    scheduled: tuple[int, int],
    expires: tuple[int, int] = INSTANT_MAX,
    created: tuple[int, int] = INSTANT_MIN,
    id_: str = "3f2c9d10-7b5e-4c61-9a84-0d6e5f18b2c7",
    destination: bytes = b"output.topic.a",
    version: int = 0,
) -> bytes:
    """The binary header, built with Python's own integers."""
    out = bytes([version])
    for sec, nano in (scheduled, expires, created):
        out += (sec + 2**63).to_bytes(8, "big") + (nano + 2**31).to_bytes(4, "big")
    return out + bytes.fromhex(id_.replace("-", "")) + destination
