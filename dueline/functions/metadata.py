"""The binary metadata header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.schema import INSTANT_MAX, INSTANT_MIN

# The layout of the binary header. Numbers are big endian with the sign bit flipped.
#   version, 1 byte | scheduled, expires, created: 8 bytes seconds + 4 bytes nanoseconds each
#   | id, 16 bytes | destination, UTF-8, 0 to 249 bytes
VERSION_HEX = "00"
INSTANT_OFFSETS = {"scheduled": 1, "expires": 13, "created": 25}
ID_OFFSET, ID_SIZE = 37, 16
DESTINATION_OFFSET, MAX_DESTINATION = 53, 249
MIN_SIZE, MAX_SIZE = 53, 302

SIGN_BIT_32 = 2**31
NANOS_PER_SECOND = 1_000_000_000


def decode_instants(df: DataFrame, value: Column, into: str) -> DataFrame:
    """First half of reading a binary metadata header: is it usable, and its three instants.

    Adds ``<into>_<field>`` for the seconds and nanoseconds, all null if the header is not usable,
    and ``<into>_reject``, the reason for that: too_short, too_long, bad_version or bad_instant.
    Nanoseconds outside a second are carried into the seconds.
    """
    reject, digits = F.col(f"{into}_reject"), F.col(f"_{into}_hex")
    df = df.withColumn(
        f"{into}_reject",
        F.when(F.length(value) < MIN_SIZE, "too_short")
        .when(F.length(value) > MAX_SIZE, "too_long")
        .when(F.hex(F.substring(value, 1, 1)) != VERSION_HEX, "bad_version"),
    )
    df = df.withColumn(f"_{into}_hex", F.when(reject.isNull(), F.hex(value)))
    stored = {}
    for name, offset in INSTANT_OFFSETS.items():
        stored[f"_{into}_{name}_sec"] = _stored_seconds(digits, offset)
        stored[f"_{into}_{name}_nano"] = _number(digits, 2 * offset + 17, 8) - SIGN_BIT_32
    df = df.withColumns(stored)
    carried, usable = {}, F.lit(True)
    for name in INSTANT_OFFSETS:
        sec, nano = F.col(f"_{into}_{name}_sec"), F.col(f"_{into}_{name}_nano")
        nano_in_second = F.pmod(nano, F.lit(NANOS_PER_SECOND))
        carry = F.call_function("div", nano - nano_in_second, F.lit(NANOS_PER_SECOND))
        carried[f"_{into}_{name}_sec"] = sec + carry
        carried[f"_{into}_{name}_nano"] = nano_in_second.cast("int")
        seconds = F.col(f"_{into}_{name}_sec")
        usable = usable & seconds.between(INSTANT_MIN[0], INSTANT_MAX[0])
    df = df.withColumns(carried)
    df = df.withColumn(f"_{into}_usable", F.coalesce(usable, F.lit(False)))
    fields = [f"{name}_{unit}" for name in INSTANT_OFFSETS for unit in ("sec", "nano")]
    bad = digits.isNotNull() & ~F.col(f"_{into}_usable")
    df = df.withColumns(
        {f"{into}_{f}": F.when(F.col(f"_{into}_usable"), F.col(f"_{into}_{f}")) for f in fields}
        | {f"{into}_reject": F.when(bad, "bad_instant").otherwise(reject)}
    )
    return df.drop(*[f"_{into}_{f}" for f in [*fields, "hex", "usable"]])


def id_bytes(value: Column) -> Column:
    return F.substring(value, 1 + ID_OFFSET, ID_SIZE)


def destination_bytes(value: Column) -> Column:
    return F.substring(value, 1 + DESTINATION_OFFSET, MAX_DESTINATION)


def _number(digits: Column, start: int, length: int) -> Column:
    """Up to 15 hex digits as a non-negative bigint."""
    return F.conv(F.substring(digits, start, length), 16, 10).cast("bigint")


def _stored_seconds(digits: Column, offset: int) -> Column:
    """Eight bytes with the sign bit flipped. Instants need less than 60 bits, so the first digit
    is 8 for seconds from 1970 on and 7 before; other numbers become null."""
    first = F.substring(digits, 2 * offset + 1, 1)
    rest = _number(digits, 2 * offset + 2, 15)
    return F.when(first == "8", rest).when(first == "7", rest - 2**60)


def encode_metadata(fields: dict[str, Column]) -> Column:
    """Metadata fields -> binary header.

    Null if a field is null or the destination is too long.
    """
    pieces = [F.lit(VERSION_HEX)]
    for name in INSTANT_OFFSETS:
        flipped = fields[f"{name}_sec"].bitwiseXOR(F.lit(-(2**63)))
        nano = fields[f"{name}_nano"].cast("bigint") + SIGN_BIT_32
        pieces += [F.lpad(F.hex(flipped), 16, "0"), F.lpad(F.hex(nano), 8, "0")]
    pieces.append(F.translate(fields["id"], "-", ""))
    destination = fields["destination"].cast("binary")
    pieces.append(F.hex(destination))
    return F.when(F.length(destination) <= MAX_DESTINATION, F.unhex(F.concat(*pieces)))
