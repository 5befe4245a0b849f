"""Time arithmetic on microsecond positions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR_MICROS = 3_600_000_000
DAY_MICROS = 24 * HOUR_MICROS
_UNIT_MICROS = {
    "microsecond": 1,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": HOUR_MICROS,
    "day": DAY_MICROS,
    "week": 7 * DAY_MICROS,
}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ref(name: str) -> Column:
    """A column by its literal name; names here hold spaces, dots, `%` and brackets."""
    return F.col(quoted(name))


def width_micros(width: str | int) -> int:
    """`"6 hours"` as microseconds; an int is taken as it is (positions that are not times)."""
    if isinstance(width, int):
        return width
    match = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", width.lower())
    if not match or match.group(2) not in _UNIT_MICROS or int(match.group(1)) == 0:
        raise ValueError(f"Not a duration: {width!r}")
    return int(match.group(1)) * _UNIT_MICROS[match.group(2)]


def position(df: DataFrame, ts: str) -> Column:
    """The place of a row on its time line as a bigint: microseconds, or an integer column as is.

    Timestamps without zone are read off the calendar fields, so the session zone plays no part.
    """
    kind = df.schema[ts].dataType
    col = quoted(ts)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return ref(ts).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(ref(ts))
    if isinstance(kind, T.DateType):
        return F.expr(f"unix_date({col}) * {DAY_MICROS}L")
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(
            f"unix_date(cast({col} AS DATE)) * {DAY_MICROS}L + hour({col}) * {HOUR_MICROS}L"
            f" + minute({col}) * 60000000L"
            f" + cast(extract(SECOND FROM {col}) * 1000000 AS BIGINT)"
        )
    raise TypeError(f"{ts!r} is {kind.simpleString()}, not a time or an integer position")


def bucket_of(pos: str, width: int) -> Column:
    """Index of the bucket of `width` that holds the position `pos` (SQL), also before 1970."""
    return F.expr(f"(({pos}) - pmod({pos}, {width}L)) div {width}L")
