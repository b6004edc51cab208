"""Instants with nanoseconds over a billion years: (seconds, nanoseconds) pairs.

Spark timestamps hold microseconds and a smaller range, so they are used only for arrival times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dueline.schema import INSTANT_MAX, INSTANT_MIN, US_PER_SECOND

# ISO instant, in UTC or with an offset in its place (ZONED_TEXT). Years of four digits, more digits only with a sign, no negative zero year.
INSTANT_TEXT = (
    r"(?i)^(\d{4}|\+\d{5,10}|-(?!0+-)\d{4,10})-\d{2}-\d{2}"
    r"T\d{2}:\d{2}:\d{2}(\.\d{0,9})?Z\z"
)
# What stands before an offset, its sign, hours, minutes and seconds.
ZONED_TEXT = r"(?s)^(.*)([+-])(\d{2}):([0-5]\d)(?::([0-5]\d))?\z"
MAX_OFFSET_SECONDS = 18 * 3600
# Seconds beyond this do not fit a bigint of microseconds.
MAX_MICRO_SECONDS = 9_000_000_000_000
SECONDS_IN_400_YEARS = 146_097 * 86_400


def parse_instants(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Add ``<name>_sec`` and ``<name>_nano`` for each ISO instant text; null if it is not one.

    The calendar repeats every 400 years, so a date and time are checked and counted inside
    2000-2399 by Spark's own timestamp cast and moved by whole cycles. The end of a day may be
    written 24:00:00, and a leap second counts as the second before it.

    Texts with an offset from UTC are first cut into the rest and the offset's seconds.

    One projection per step, for all texts at once, so that a value used twice is computed once.
    """
    df = df.withColumns({f"_{n}_zoned": _zoned(text) for n, text in texts.items()})
    utc = {n: F.coalesce(F.col(f"_{n}_zoned.text"), text) for n, text in texts.items()}
    df = df.withColumns(
        {f"_{n}_text": F.upper(F.when(text.rlike(INSTANT_TEXT), text)) for n, text in utc.items()}
    )
    steps = {}
    for n in texts:
        text = F.col(f"_{n}_text")
        at = F.instr(text, "T")
        steps[f"_{n}_year"] = F.substring(text, F.lit(1), at - 7).try_cast("bigint")
        steps[f"_{n}_rest"] = F.substring(text, at - 6, F.lit(15))
        fraction = F.substring(text, at + 10, F.length(text) - at - 10)
        steps[f"_{n}_nano"] = F.rpad(fraction, 9, "0").try_cast("int")
    df = df.withColumns(steps)
    df = df.withColumns({f"_{n}_cycle": F.pmod(F.col(f"_{n}_year"), F.lit(400)) for n in texts})
    df = df.withColumns({f"_{n}_epoch": _epoch_seconds(n) for n in texts})
    known = {n: F.col(f"_{n}_epoch").between(INSTANT_MIN[0], INSTANT_MAX[0]) for n in texts}
    df = df.withColumns(
        {f"{n}_sec": F.when(known[n], F.col(f"_{n}_epoch")) for n in texts}
        | {f"{n}_nano": F.when(known[n], F.col(f"_{n}_nano")) for n in texts}
    )
    steps = ("zoned", "text", "year", "rest", "nano", "cycle", "epoch")
    return df.drop(*[f"_{n}_{step}" for n in texts for step in steps])


def _zoned(text: Column) -> Column:
    """The text in UTC form and its offset in seconds; null if it has no offset or one over 18 hours.

    The lambda ends the generated method here; it is looked at only for texts that don't end in Z.
    """

    def cut(t: Column) -> Column:
        sign, hours, minutes, seconds = (F.regexp_extract(t, ZONED_TEXT, i) for i in range(2, 6))
        size = hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60 + F.coalesce(seconds.try_cast("int"), F.lit(0))
        rest = F.concat(F.regexp_extract(t, ZONED_TEXT, 1), F.lit("Z"))
        offset = F.when(sign == "-", -size).otherwise(size)
        return F.when(size <= MAX_OFFSET_SECONDS, F.struct(rest.alias("text"), offset.alias("offset")))

    utc = F.endswith(text, F.lit("Z")) | F.endswith(text, F.lit("z"))
    return F.when(~utc, F.transform(F.array(text), cut)[0])


def _epoch_seconds(name: str) -> Column:
    year, rest, nano, cycle = (F.col(f"_{name}_{s}") for s in ("year", "rest", "nano", "cycle"))
    day_end = F.endswith(rest, F.lit("T24:00:00")) & (nano == 0)
    rest = F.when(day_end, F.concat(F.left(rest, F.lit(7)), F.lit("00:00:00"))).otherwise(
        F.replace(rest, F.lit("T23:59:60"), F.lit("T23:59:59"))
    )
    in_cycle = F.concat(cycle + 2000, rest, F.lit("Z")).try_cast("timestamp").cast("bigint")
    cycles = F.call_function("div", year - cycle - 2000, F.lit(400))
    offset = F.coalesce(F.col(f"_{name}_zoned.offset"), F.lit(0))
    return in_cycle + cycles * SECONDS_IN_400_YEARS + F.when(day_end, 86400).otherwise(0) - offset


def instant_after(sec: Column, nano: Column, other_sec: Column, other_nano: Column) -> Column:
    """Is the first instant strictly later than the second?"""
    return (sec > other_sec) | ((sec == other_sec) & (nano > other_nano))


def instant_from_micros(us: Column) -> tuple[Column, Column]:
    """Epoch microseconds -> (sec, nano)."""
    into_second = F.pmod(us, F.lit(US_PER_SECOND))
    return (
        F.call_function("div", us - into_second, F.lit(US_PER_SECOND)),
        (into_second * 1000).cast("int"),
    )


def instant_to_micros(sec: Column, nano: Column) -> Column:
    """(sec, nano) -> epoch microseconds, rounded up; instants out of range stop at its ends."""
    clamped = F.greatest(F.least(sec, F.lit(MAX_MICRO_SECONDS)), F.lit(-MAX_MICRO_SECONDS))
    return clamped * US_PER_SECOND + F.ceil(nano / 1000)


def ceil_to_grid(us: Column, step: int, origin: int = 0) -> Column:
    """The first instant at or after ``us`` that is a whole number of steps from ``origin``."""
    return us + F.pmod(F.lit(origin) - us, F.lit(step))
