"""Lake readings to features and targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gaugeline import names as N
from gaugeline.functions.columns import date_column, flag_column, level_column
from gaugeline.functions.values import with_numbers, with_timestamp
from gaugeline.operators.clean import (
    drop_incomplete_lags, drop_undated, drop_zero_level, fill_hour,
)
from gaugeline.operators.lags import add_future_levels, add_time_lags, flag_number, lake_lags, times_spacing
from gaugeline.plans.timeline import DEFAULT_BUCKET, resolve_bucket
from gaugeline.session import settle


def lake_features(
    df: DataFrame,
    horizons: Sequence[int] = N.HORIZONS,
    *,
    date: str | None = None,
    level: str | None = None,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Dated, cleaned readings with level and air lags, minutes-on, future levels and changes.

    The order of the steps is part of the result: zero levels go before the lags are looked up,
    rows without a lag go before the future is, so futures are those of surviving rows. Without
    an air temperature there are no lags. Minutes-on are scaled last: a row with a lag has a row
    before it, so the spacing it is multiplied by is never missing and cannot drop a row.

    The cleaned readings and the lagged rows are written on the way: the source is read and parsed
    once, and full rows are shuffled twice, once for the lags and once for the future.
    """
    value = level_column(df.columns, level)
    if not value:
        raise ValueError("No level column found.")
    ts = date_column(df.columns, date)
    clean = settle(drop_undated(_cleaned(df, ts, value), ts))
    options = dict(ts=ts, keys=keys, bucket=resolve_bucket(clean, ts, keys, bucket))
    lagged, on = _lagged(clean, value, tiebreak=tiebreak, **options)
    lagged = settle(drop_incomplete_lags(lagged))
    full = add_future_levels(lagged, value, horizons, tiebreak=tiebreak, **options)
    return times_spacing(full, on, clean, **options) if on else full


def lake_lag_table(
    df: DataFrame,
    *,
    date: str | None = None,
    level: str | None = None,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """The same without future columns. Without level or air temperature it only cleans."""
    value = level_column(df.columns, level)
    ts = date_column(df.columns, date)
    clean = _cleaned(df, ts, value)
    if not value or N.AIR_TEMP not in df.columns:
        return drop_incomplete_lags(clean)
    dated = settle(drop_undated(clean, ts))
    options = dict(ts=ts, keys=keys, bucket=resolve_bucket(dated, ts, keys, bucket))
    lagged, on = _lagged(dated, value, tiebreak=tiebreak, **options)
    full = drop_incomplete_lags(lagged)
    return times_spacing(full, on, dated, **options) if on else full


def _cleaned(df: DataFrame, ts: str, value: str | None) -> DataFrame:
    typed = with_timestamp(df, ts)
    numeric = [c for c in (value, N.AIR_TEMP, flag_column(df.columns)) if c]
    return drop_zero_level(fill_hour(with_numbers(typed, numeric), ts), value)


def _lagged(df: DataFrame, value: str, **options) -> tuple[DataFrame, list[str]]:
    """Lags and on-counts in one shuffle, and the names of the on-counts."""
    if N.AIR_TEMP not in df.columns:
        return df, []
    flag = flag_column(df.columns)
    rolling = {N.FLAG_LAG_PREFIX + s: ("__flag", h) for s, h in N.LAKE_LAG_HOURS.items() if flag}
    flagged = df.withColumn("__flag", flag_number(flag)) if flag else df
    return add_time_lags(flagged, lake_lags(value), rolling=rolling, **options).drop("__flag"), list(rolling)
