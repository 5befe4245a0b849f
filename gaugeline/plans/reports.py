"""Coverage and daily-fit reports, and the table around flag transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gaugeline import names as N
from gaugeline.functions.columns import date_column, drop_matching, insert_after
from gaugeline.functions.time import ref
from gaugeline.functions.values import (
    count_unreadable_dates, with_numbers, with_timestamp,
)
from gaugeline.operators.clean import drop_undated
from gaugeline.operators.coverage import daily_coverage, day_blocks
from gaugeline.operators.fit import append_fit_summary, daily_fit
from gaugeline.operators.neighbourhood import join_first_at_time, near_events
from gaugeline.operators.sequence import mark_transitions
from gaugeline.plans.timeline import DEFAULT_BUCKET, resolve_bucket
from gaugeline.session import settle


def coverage_report(
    df: DataFrame, *, date: str = N.DATE, keys: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Daily coverage, blocks of consecutive days and the count of unreadable dates."""
    if date not in df.columns:
        raise ValueError(f"No column {date!r}.")
    days = daily_coverage(with_timestamp(df, date), ts=date, keys=keys)
    return {
        "daily_time_coverage": days,
        "consecutive_day_blocks": day_blocks(days, keys=keys),
        "dropped_rows": count_unreadable_dates(df, date),
    }


def daily_fit_report(
    df: DataFrame,
    *,
    date: str | None = None,
    value: str = N.LEVEL,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The line fit of each day and the summary row."""
    ts = date_column(df.columns, date)
    typed = with_numbers(with_timestamp(df, ts), [value])
    return append_fit_summary(daily_fit(typed, ts=ts, value=value, keys=keys), keys)


def transition_table(
    features: DataFrame,
    readings: DataFrame,
    *,
    flag: str = N.FLAG,
    hours: int = N.TRANSITION_REACH_HOURS,
    ts: str = N.DATE,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Feature rows within 12 hours of a flag transition in `readings`, with its flag columns.

    Kept times and flag columns come from the same readings, so one join serves for both.
    """
    extra = [c for c in (flag, *[N.FLAG_LAG_PREFIX + s for s in N.LAKE_LAG_HOURS])
             if c in readings.columns]
    typed = drop_undated(with_numbers(with_timestamp(readings, ts), [flag]), ts)
    needed = list(dict.fromkeys([*keys, ts, *tiebreak, *extra]))
    width = resolve_bucket(typed, ts, keys, bucket)
    options = dict(ts=ts, keys=keys, tiebreak=tiebreak, bucket=width)
    marked = settle(mark_transitions(
        settle(typed.select(*[ref(c) for c in needed])), flag, "__changed", **options
    ))
    near = near_events(marked, "__changed", hours, **options)
    joined = join_first_at_time(
        with_timestamp(features, ts), near, extra, ts=ts, keys=keys, tiebreak=tiebreak
    )
    placed = insert_after(joined, extra, N.LEVEL)
    trimmed = drop_matching(placed, f"{N.DELTA_PREFIX}.*")
    return drop_matching(trimmed, N.FUTURE_LEVEL_PATTERN, keep=(f"{N.LEVEL}_1h",))
