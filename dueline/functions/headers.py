"""Header lists: ordered, duplicates allowed, the last one of a name counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dueline.schema import HEADERS_TYPE, HeaderNames


def last_header(headers: Column, name: str) -> Column:
    """Value of the last header called ``name``; null if there is none.

    Built from array functions that have generated code; a lambda would be interpreted per element.
    """
    from_the_end = F.array_position(F.reverse(headers["key"]), name)
    return F.try_element_at(headers["value"], (-F.nullif(from_the_end, F.lit(0))).cast("int"))


def without_headers(headers: Column, names: list[str]) -> Column:
    """Drop every header with one of these names; no headers at all become an empty list."""
    kept = F.filter(headers, lambda h: ~F.coalesce(h["key"].isin(*names), F.lit(False)))
    return F.coalesce(kept, F.array().cast(HEADERS_TYPE))


def strip_control_headers(headers: Column, names: HeaderNames = HeaderNames()) -> Column:
    return without_headers(headers, names.control)


def append_header(headers: Column, name: str, value: Column) -> Column:
    """Add one header at the end."""
    added = F.array(F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value")))
    return F.concat(F.coalesce(headers, F.array().cast(HEADERS_TYPE)), added.cast(HEADERS_TYPE))
