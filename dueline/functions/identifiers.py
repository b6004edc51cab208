"""Request ids: 128 bits, kept as lower-case 8-4-4-4-12 text.

Sorting this text gives the same order as sorting the 16 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_TEXT = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"


def uuid_from_hex(digits: Column) -> Column:
    """32 hex digits -> id text."""
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.lower(F.concat_ws("-", *[F.substring(digits, at, n) for at, n in cuts]))


def parse_uuid(value: Column) -> Column:
    """Id from 16 raw bytes or from 36 characters of text; null for anything else."""
    text = value.cast("string")
    return F.when(F.length(value) == 16, uuid_from_hex(F.hex(value))).when(
        (F.length(value) == 36) & text.rlike(UUID_TEXT), F.lower(text)
    )


def message_uuid(topic: Column, partition: Column, offset: Column) -> Column:
    """Id for a message that carries none: the same message always gets the same id,
    so a task that is run again does not schedule it twice. Laid out as a name-based UUID."""
    digest = F.md5(F.concat_ws("|", topic, partition, offset))
    return uuid_from_hex(
        F.concat(
            F.substring(digest, 1, 12),
            F.lit("3"),
            F.substring(digest, 14, 3),
            F.lit("8"),
            F.substring(digest, 18, 15),
        )
    )
