"""Requests written as JSON in the message value instead of in headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueline.functions import append_header
from dueline.schema import HeaderNames

JSON_FIELDS = ["scheduled", "expires", "created", "id", "destination"]


def headers_from_json(messages: DataFrame, names: HeaderNames = HeaderNames()) -> DataFrame:
    """Turn ``{"scheduled": .., "expires": .., "created": .., "id": .., "destination": ..,
    "key": .., "value": ..}`` into a message with text control headers.

    The result goes through the same ingest as any message; a value that is no such object keeps
    its own headers, key and value.
    """
    schema = ", ".join(f"{field} string" for field in [*JSON_FIELDS, "key", "value"])
    df = messages.withColumn("_json", F.from_json(F.col("value").cast("string"), schema))
    given = F.col("_json.scheduled").isNotNull() & F.col("_json.destination").isNotNull()
    tagged = F.col("headers")
    for field in JSON_FIELDS:
        tagged = append_header(tagged, getattr(names, field), F.col(f"_json.{field}"))
    return df.withColumns(
        {
            "headers": F.when(given, tagged).otherwise(F.col("headers")),
            "key": F.when(given, F.col("_json.key").cast("binary")).otherwise(F.col("key")),
            "value": F.when(given, F.col("_json.value").cast("binary")).otherwise(F.col("value")),
        }
    ).drop("_json")
