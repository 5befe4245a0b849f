"""As-of lags, future levels and rolling on-time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import names as N
from gaugeline.functions.time import HOUR_MICROS, ref
from gaugeline.operators.sequence import median_spacing
from gaugeline.plans.timeline import (
    DEFAULT_BUCKET, Lookup, RollingSum, look_up, resolve_bucket,
)


def add_time_lags(
    df: DataFrame,
    lags: Mapping[str, tuple[str, int]],
    *,
    ts: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
    rolling: Mapping[str, tuple[str, int]] | None = None,
) -> DataFrame:
    """Backward as-of lags: `lags` maps a new column to (source column, hours).

    Each value is the one of the latest row at or before `t - hours`, however old that row is.
    `rolling` maps further columns to (source column, hours) sums over `(t - hours, t]`. All of
    them share one shuffle.
    """
    hours = sorted({h for _, h in lags.values()})
    sources = list(dict.fromkeys(c for c, _ in lags.values()))
    rolling = dict(rolling or {})
    plain = df.drop(*[c for c in [*lags, *rolling] if c in df.columns])
    found = look_up(
        plain,
        ts=ts,
        sources=sources,
        lookups=[Lookup(f"__lag{h}", h * HOUR_MICROS) for h in hours] if lags else [],
        sums=[RollingSum(out, c, h * HOUR_MICROS) for out, (c, h) in rolling.items()],
        keys=keys,
        tiebreak=tiebreak,
        bucket=bucket,
    )
    return found.select(
        *[ref(c) for c in plain.columns],
        *[F.col(f"__lag{h}").getField(c).alias(out) for out, (c, h) in lags.items()],
        *[ref(out) for out in rolling],
    )


def lake_lags(level: str | None) -> dict[str, tuple[str, int]]:
    """The lag set of a lake table. The suffixes 15/30/60 stand for 1, 3 and 6 hours."""
    out: dict[str, tuple[str, int]] = {}
    if level:
        out |= {N.LEVEL_LAG_PREFIX + s: (level, h) for s, h in N.LAKE_LAG_HOURS.items()}
    return out | {N.AIR_LAG_PREFIX + s: (N.AIR_TEMP, h) for s, h in N.LAKE_LAG_HOURS.items()}


def add_future_levels(
    df: DataFrame,
    level: str,
    horizons: Sequence[int] = N.HORIZONS,
    *,
    ts: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Level at the first row at or after `t + h`, and its change since `t`, for each horizon.

    Both are rounded half-even to 10 decimals. The change is missing if either level is.
    """
    new = [c for h in horizons for c in (f"{N.DELTA_PREFIX}{h}h", f"{level_name(h)}")]
    plain = df.drop(*[c for c in new if c in df.columns])
    found = look_up(
        plain,
        ts=ts,
        sources=[level],
        lookups=[Lookup(f"__next{h}", h * HOUR_MICROS, forward=True) for h in horizons],
        keys=keys,
        tiebreak=tiebreak,
        bucket=bucket,
    )
    out = [ref(c) for c in plain.columns]
    for h in horizons:
        future = F.col(f"__next{h}").getField(level)
        out.append(F.bround(future - ref(level), 10).alias(f"{N.DELTA_PREFIX}{h}h"))
        out.append(F.bround(future, 10).alias(level_name(h)))
    return found.select(*out)


def level_name(hours: int) -> str:
    return f"{N.LEVEL}_{hours}h"


def minutes_on(
    df: DataFrame,
    flag: str,
    outputs: Mapping[str, int],
    *,
    ts: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Minutes the flag was on in the last hours: on-rows in `(t - h, t]` times median spacing.

    Flags are summed as decimals (`flag_number`).

    `outputs` maps new columns to hours. The median spacing is that of the whole series. Rows of
    equal time count for each other.
    """
    bucket = resolve_bucket(df, ts, keys, bucket)
    rows = add_time_lags(
        df.withColumn("__flag", flag_number(flag)), {}, ts=ts, keys=keys, tiebreak=tiebreak,
        bucket=bucket, rolling={out: ("__flag", h) for out, h in outputs.items()},
    ).drop("__flag")
    return times_spacing(rows, list(outputs), df, ts=ts, keys=keys, bucket=bucket)


def flag_number(flag: str) -> Column:
    """A flag, or a share of one with up to six decimals, as a decimal, whose sums are exact."""
    return ref(flag).cast("double").cast("decimal(18,6)")


def times_spacing(
    rows: DataFrame,
    columns: Sequence[str],
    series: DataFrame,
    *,
    ts: str,
    keys: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Multiply `columns` by the median spacing, in minutes, of the series the rows belong to."""
    step = median_spacing(series, "__step", ts=ts, keys=keys, bucket=bucket)
    if keys:
        names = [f"__k{i}" for i in range(len(keys))]
        match = F.lit(True)
        for k, name in zip(keys, names):
            match = match & ref(k).eqNullSafe(F.col(name))
        scaled = rows.join(step.toDF(*names, "__step"), match, "left")
    else:
        scaled = rows.withColumn("__step", step.scalar())
    return scaled.select(
        *[
            (ref(c).cast("double") * F.col("__step")).alias(c) if c in columns else ref(c)
            for c in rows.columns
        ]
    )
