"""From raw messages to schedule requests, and back: reading and writing the control headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.functions import (
    append_header,
    decode_instants,
    destination_bytes,
    encode_metadata,
    id_bytes,
    last_header,
    message_uuid,
    parse_instants,
    parse_uuid,
    strip_control_headers,
    without_headers,
)
from dueline.schema import (
    INSTANT_MAX,
    INSTANT_MIN,
    MESSAGE_ID,
    METADATA_FIELDS,
    REQUEST_COLUMNS,
    HeaderNames,
)

INSTANTS = ["scheduled", "expires", "created"]
INSTANT_FIELDS = [f"{name}_{unit}" for name in INSTANTS for unit in ("sec", "nano")]


def extract_metadata(messages: DataFrame, names: HeaderNames = HeaderNames()) -> DataFrame:
    """Add the metadata columns of every message.

    The binary header counts if it is usable, else the text headers. Text headers may leave out
    expires (never expires), created (unknown) and id (derived from the message's own position).
    Without a scheduled time or a destination all metadata columns are null. ``metadata_reject``
    says what is wrong with a binary header that is there but cannot be used.
    """
    df = messages.withColumn("_binary", last_header(F.col("headers"), names.metadata))
    df = decode_instants(df, F.col("_binary"), "binary")

    # The text headers, only where the binary one is of no use. The lambda also ends the generated
    # method here: both halves in one would be too long for the JVM to compile.
    usable = F.col("binary_scheduled_sec").isNotNull()
    text_names = [name for name in names.control if name != names.metadata]
    df = df.withColumns(
        {
            "_usable": usable,
            "_text": F.when(~usable, F.filter("headers", lambda h: h["key"].isin(*text_names))),
        }
    )
    df = df.withColumns(
        {f"_{field}": last_header(F.col("_text"), getattr(names, field)) for field in INSTANTS}
        | {
            "_id": F.when(F.col("_usable"), id_bytes(F.col("_binary"))).otherwise(
                last_header(F.col("_text"), names.id)
            ),
            "_destination": F.when(
                F.col("_usable"), destination_bytes(F.col("_binary"))
            ).otherwise(last_header(F.col("_text"), names.destination)),
        }
    )
    df = parse_instants(df, {f"text_{f}": F.col(f"_{f}").cast("string") for f in INSTANTS})

    found = {f: F.coalesce(F.col(f"binary_{f}"), F.col(f"text_{f}")) for f in INSTANT_FIELDS}
    for field, default in [("expires", INSTANT_MAX), ("created", INSTANT_MIN)]:
        for unit, value in zip(("sec", "nano"), default, strict=True):
            found[f"{field}_{unit}"] = F.coalesce(found[f"{field}_{unit}"], F.lit(value))
    found["id"] = F.coalesce(
        parse_uuid(F.col("_id")), message_uuid(*[F.col(c) for c in MESSAGE_ID])
    )
    found["destination"] = F.make_valid_utf8(F.col("_destination").cast("string"))
    is_request = F.coalesce("binary_scheduled_sec", "text_scheduled_sec").isNotNull() & F.col(
        "_destination"
    ).isNotNull()
    # Through a generator of no or one row: the optimizer moves filters below projections and
    # copies the expressions into them, step into step, which would repeat the whole parsing many
    # times over. It does not do so here.
    fields = F.struct(*[found[f].alias(f) for f in METADATA_FIELDS])
    return df.select(
        *messages.columns,
        F.col("binary_reject").alias("metadata_reject"),
        F.inline_outer(F.when(is_request, F.array(fields))),
    ).select(*messages.columns, *METADATA_FIELDS, "metadata_reject")


def parse_messages(messages: DataFrame, names: HeaderNames = HeaderNames()) -> DataFrame:
    """Messages with their metadata, arrival time and, where they are no request, the reason."""
    df = extract_metadata(messages, names)
    return df.withColumns(
        {
            "arrival_us": F.unix_micros("timestamp"),
            "reason": F.when(F.col("id").isNull(), "no_metadata").when(
                F.col("timestamp").isNull(), "no_timestamp"
            ),
        }
    )


def with_stored_payload(messages: DataFrame, names: HeaderNames = HeaderNames()) -> DataFrame:
    """Key, value and headers as they are kept: control headers off, empty key and value null."""
    empty = F.lit(b"")
    return messages.withColumns(
        {
            "key": F.nullif("key", empty),
            "value": F.nullif("value", empty),
            "headers": strip_control_headers(F.col("headers"), names),
        }
    )


def requests_of(parsed: DataFrame, names: HeaderNames = HeaderNames()) -> DataFrame:
    """The usable messages as requests."""
    usable = parsed.filter(F.col("reason").isNull())
    return with_stored_payload(usable, names).select(*REQUEST_COLUMNS)


def quarantine_of(parsed: DataFrame, names: HeaderNames = HeaderNames()) -> DataFrame:
    """The messages that are no request, as they came, with the reason also as an error header."""
    return parsed.filter(F.col("reason").isNotNull()).select(
        *MESSAGE_ID,
        "timestamp",
        "key",
        "value",
        with_error_header(F.col("headers"), F.col("reason"), names).alias("headers"),
        "reason",
        F.col("metadata_reject").alias("detail"),
    )


def ingest(
    messages: DataFrame, names: HeaderNames = HeaderNames()
) -> tuple[DataFrame, DataFrame]:
    """Split messages into requests and quarantine."""
    parsed = parse_messages(messages, names)
    return requests_of(parsed, names), quarantine_of(parsed, names)


def with_error_header(headers: Column, error: Column, names: HeaderNames = HeaderNames()) -> Column:
    return append_header(headers, names.error, error)


def tag_requests(
    df: DataFrame, fields: dict[str, Column], names: HeaderNames = HeaderNames()
) -> DataFrame:
    """Turn any table with a ``headers`` column into messages for the scheduler.

    ``fields`` gives the metadata; expires, created and id may be left out. The binary metadata
    header is replaced; where the metadata is null or the destination too long it is only removed.
    """
    missing = {"scheduled_sec", "scheduled_nano", "destination"} - set(fields)
    if missing:
        raise ValueError(f"missing metadata fields: {sorted(missing)}")
    defaults = {
        "expires_sec": F.lit(INSTANT_MAX[0]),
        "expires_nano": F.lit(INSTANT_MAX[1]),
        "created_sec": F.lit(INSTANT_MIN[0]),
        "created_nano": F.lit(INSTANT_MIN[1]),
    }
    if "id" not in fields:
        defaults["id"] = message_uuid(*[F.col(c) for c in MESSAGE_ID])
    fields = defaults | fields
    others = without_headers(F.col("headers"), [names.metadata])
    tagged = df.withColumns({"_encoded": encode_metadata(fields), "headers": others})
    return tagged.withColumn(
        "headers",
        F.when(F.col("_encoded").isNull(), F.col("headers")).otherwise(
            append_header(F.col("headers"), names.metadata, F.col("_encoded"))
        ),
    ).drop("_encoded")


__all__ = [
    "extract_metadata",
    "ingest",
    "parse_messages",
    "quarantine_of",
    "requests_of",
    "tag_requests",
    "with_error_header",
    "with_stored_payload",
]
