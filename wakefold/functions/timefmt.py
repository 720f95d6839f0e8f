"""Time normalisation: epoch forms, canonical text and time-of-day arithmetic."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"
DAY_SECONDS = 86_400


def epoch_ms(value: Column, data_type: T.DataType) -> Column:
    """Milliseconds since the epoch.

    Numbers are milliseconds already. Timestamps are converted, so a column that was
    parsed earlier is never mistaken for a number. All-digit text is milliseconds; other
    text is parsed and has whole-second precision; unreadable text gives null.
    """
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.floor(F.unix_micros(value.cast("timestamp")) / F.lit(1000)).cast("long")
    if isinstance(data_type, T.NumericType):
        return value.cast("long")
    text = F.trim(value.cast("string"))
    parsed = F.unix_seconds(F.try_to_timestamp(F.regexp_replace(text, "T", " "))) * F.lit(1000)
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).otherwise(parsed)


def epoch_seconds(value: Column, data_type: T.DataType) -> Column:
    return F.floor(epoch_ms(value, data_type) / F.lit(1000)).cast("long")


def to_timestamp(value: Column, data_type: T.DataType) -> Column:
    """Timestamp without its sub-second part."""
    return F.timestamp_seconds(epoch_seconds(value, data_type))


def ms_text(ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of epoch milliseconds (session zone, kept at UTC)."""
    return F.date_format(F.timestamp_seconds(F.floor(ms / F.lit(1000)).cast("long")), TEXT_FORMAT)


def canonical_datetime(text: str) -> str:
    """Check a user argument; accepts ``T`` or a blank and drops fractions of a second."""
    cleaned = re.sub(r"\.\d+", "", text.strip()).replace("T", " ").rstrip("Z")
    return datetime.strptime(cleaned, "%Y-%m-%d %H:%M:%S").strftime("%Y-%m-%d %H:%M:%S")


def canonical_epoch_seconds(text: str) -> int:
    moment = datetime.strptime(canonical_datetime(text), "%Y-%m-%d %H:%M:%S")
    return int((moment - datetime(1970, 1, 1)).total_seconds())


def day_seconds(text: Column) -> Column:
    """Second of the day of one text cell.

    Digits alone are seconds and wrap at one day; otherwise the first ``HH:MM:SS`` counts.
    """
    trimmed = F.trim(text)
    found = F.regexp_extract(trimmed, r"\d{2}:\d{2}:\d{2}", 0)
    hours, minutes, seconds = (F.substring(found, at, 2).try_cast("long") for at in (1, 4, 7))
    clock = (hours * 3600 + minutes * 60 + seconds) % DAY_SECONDS
    return F.when(trimmed.rlike("^[0-9]+$"), trimmed.try_cast("long") % DAY_SECONDS).otherwise(clock)


def relative_seconds(cells: Column) -> Column:
    """Seconds of each cell after the first readable one; earlier clock times wrap a day.

    An array without a readable cell gives an empty array.
    """

    def shifted(clocks: Column, base: Column) -> Column:
        moved = F.transform(
            clocks,
            lambda s: F.when(s >= base, s - base).when(s.isNotNull(), s + DAY_SECONDS - base),
        )
        return F.when(base.isNull(), F.array().cast("array<bigint>")).otherwise(moved)

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        # A lambda's argument is worked out once; a column named inside a lambda is worked out for every element.
        return F.get(F.transform(F.array(value), use), F.lit(0))

    return once(
        F.transform(cells, day_seconds),
        lambda clocks: once(F.get(F.filter(clocks, lambda s: s.isNotNull()), F.lit(0)), lambda base: shifted(clocks, base)),
    )
