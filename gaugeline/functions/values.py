"""Column expressions for reading dates and numbers and for calendar parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline import names as N
from gaugeline.functions.time import ref

# What counts as a number, and the date layouts tried after ISO.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
# One pattern of optional parts, four-digit years first, is one expression and one formatter.
DATE_FORMATS = (
    "[yyyy/M/d][M/d/yyyy][M/d/yy][M-d-yyyy][M-d-yy][d-MMM-yyyy][d-MMM-yy][d MMM yyyy][MMM d, yyyy]"
    "[yyyyMMdd][ h:mm[:ss] a][ H:mm[:ss]]",
)


def number(df: DataFrame, name: str) -> Column:
    """The column as a double; text that is no number, and NaN, become missing."""
    kind = df.schema[name].dataType
    col = ref(name)
    if isinstance(kind, T.StringType):
        return F.when(col.rlike(NUMBER_PATTERN), F.expr(f"try_cast(`{name}` AS DOUBLE)"))
    wide = col.cast("double")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), wide)
    return wide


def with_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number(df, c) for c in columns if c in df.columns})


def timestamp(df: DataFrame, name: str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The column as a timestamp without zone; what fits no layout becomes missing."""
    kind = df.schema[name].dataType
    col = ref(name)
    if not isinstance(kind, T.StringType):
        return col.cast("timestamp_ntz")
    text = F.nullif(F.trim(col), F.lit(""))
    tries = [F.expr(f"try_cast(trim(`{name}`) AS TIMESTAMP_NTZ)")]
    tries += [_this_century(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz"), text)
              for f in formats]
    return F.coalesce(*tries)


def _this_century(when: Column, text: Column) -> Column:
    """Two-digit years from 69 on belong to the last century."""
    return F.when(text.rlike("[0-9]{4}"), when).otherwise(last_century(when))


def last_century(when: Column) -> Column:
    """Years from 2069 on, read off two digits, moved to the last century."""
    return F.when(F.year(when) >= 2069, when - F.expr("INTERVAL '100' YEAR")).otherwise(when)


def with_timestamp(
    df: DataFrame, name: str, formats: Sequence[str] = DATE_FORMATS
) -> DataFrame:
    return df.withColumn(name, timestamp(df, name, formats))


def count_unreadable_dates(
    df: DataFrame, name: str, formats: Sequence[str] = DATE_FORMATS, out: str = "dropped"
) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(timestamp(df, name, formats).isNull()).alias(out),
    )


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    when = ref(ts)
    return df.withColumns(
        {"year": F.year(when), "month": F.month(when), "day": F.dayofmonth(when),
         "dayofyear": F.dayofyear(when)}
    )


def ceil_hour(ts: Column) -> Column:
    """The next full hour, or the time itself if it is one."""
    late = ts + F.expr("INTERVAL '1' HOUR") - F.expr("INTERVAL '0.000001' SECOND")
    return F.date_trunc("HOUR", late).cast("timestamp_ntz")


def hours_of_day(ts: Column) -> Column:
    """Hours since midnight; parts of a second are left out."""
    return (
        F.hour(ts).cast("double")
        + F.minute(ts) / F.lit(60.0)
        + F.second(ts) / F.lit(3600.0)
    )


def date_text(ts: Column) -> Column:
    return F.date_format(ts, N.DATE_TEXT_FORMAT)


def halve_positive(delta: Column, enabled: bool = True) -> Column:
    return F.when(delta > 0, delta * 0.5).otherwise(delta) if enabled else delta
