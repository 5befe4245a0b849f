"""Raw weather to a parsed table, yearly analytics and air-temperature lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline import names as N
from gaugeline.functions.columns import reorder, select_aliases
from gaugeline.functions.time import ref
from gaugeline.functions.values import (
    ceil_hour, date_text, timestamp, with_numbers, with_timestamp,
)
from gaugeline.operators.clean import drop_flagged_pressure, drop_undated, in_season
from gaugeline.operators.climate import average_year, best_summer_year_rows
from gaugeline.operators.lags import add_time_lags
from gaugeline.operators.sequence import fill_both_ways
from gaugeline.plans.timeline import DEFAULT_BUCKET, resolve_bucket
from gaugeline.session import settle

_VALUES = (N.AIR_TEMP, N.HUMIDITY, N.PRESSURE)


def normalise_weather(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Four weather columns under fixed names, flagged and off-season rows dropped, times rounded
    up to the hour. Only row-wise steps, so it also runs on a stream.

    The season test comes before the rounding: a reading late on September 30 moves to October 1.
    It also drops the rows without a readable date, which have no month.
    """
    picked = drop_flagged_pressure(select_aliases(df, keep=keep))
    dated = picked.withColumn("__ts", timestamp(picked, N.DATE))
    hour = ceil_hour(F.col("__ts"))
    return in_season(dated, "__ts").select(
        *[ref(k) for k in keep],
        date_text(hour).alias(N.DATE),
        *[ref(c) for c in _VALUES],
        F.hour(hour).cast("double").alias(N.HOUR),
    )


def prepare_parsed(df: DataFrame) -> DataFrame:
    """Times and numbers of a parsed weather table."""
    missing = [c for c in (N.DATE, *_VALUES) if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}; found {df.columns}")
    typed = with_numbers(with_timestamp(df, N.DATE), [*_VALUES, N.HOUR])
    return drop_undated(typed, N.DATE)


def yearly_analytics(df: DataFrame, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The hottest-summer year, the most humid one and the average year, by report name."""
    table = prepare_parsed(df)
    columns = [*keys, N.DATE, *_VALUES] + [N.HOUR] * (N.HOUR in df.columns)

    def year_of(value: str) -> DataFrame:
        rows = best_summer_year_rows(table, value, keys=keys)
        return rows.select(
            *[(date_text(ref(c)).alias(c) if c == N.DATE else ref(c)) for c in columns]
        )

    return {
        N.REPORT_HOTTEST: year_of(N.AIR_TEMP),
        N.REPORT_HUMID: year_of(N.HUMIDITY),
        N.REPORT_AVERAGE: average_year(table, _VALUES, keys=keys),
    }


def add_weather_lags(
    df: DataFrame,
    *,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Air-temperature lags of 1, 3 and 6 hours, gaps filled from before and then from after.

    Existing lag columns are replaced, so it may be run again on its own output.
    """
    missing = [c for c in (N.DATE, N.AIR_TEMP) if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    names = list(N.WEATHER_LAG_HOURS)
    typed = with_numbers(with_timestamp(df.drop(*names), N.DATE), [N.AIR_TEMP])
    width = resolve_bucket(typed, N.DATE, keys, bucket)
    options = dict(ts=N.DATE, keys=keys, tiebreak=tiebreak, bucket=width)
    lags = {c: (N.AIR_TEMP, h) for c, h in N.WEATHER_LAG_HOURS.items()}
    lagged = settle(add_time_lags(settle(typed), lags, **options))
    filled = fill_both_ways(lagged, names, **options)
    return reorder(filled, [*keys, N.DATE, *_VALUES, N.HOUR], names)
