"""Row filters and the hour column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline import names as N
from gaugeline.functions.time import ref
from gaugeline.functions.values import number


def drop_undated(df: DataFrame, ts: str) -> DataFrame:
    return df.where(ref(ts).isNotNull())


def fill_hour(df: DataFrame, ts: str, out: str = N.HOUR) -> DataFrame:
    """Keep an hour that is there and neither blank nor NaN, else take it from the time."""
    own = F.hour(ref(ts))
    if out not in df.columns:
        return df.withColumn(out, own)
    kind = df.schema[out].dataType
    there = ref(out)
    if isinstance(kind, T.StringType):
        there = F.when(F.trim(there) != "", there)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        there = F.when(~F.isnan(there), there)
    return df.withColumn(out, F.coalesce(there, own.cast(kind)))


def drop_zero_level(df: DataFrame, level: str | None) -> DataFrame:
    """A zero reading is a sensor out of the water; a missing one is kept."""
    if not level:
        return df
    value = number(df, level)
    return df.where(value.isNull() | (value != 0))


def drop_flagged_pressure(df: DataFrame, pressure: str = N.PRESSURE) -> DataFrame:
    """Drop rows whose raw pressure text carries the missing mark "m"."""
    text = F.lower(F.coalesce(ref(pressure).cast("string"), F.lit("")))
    return df.where(~text.contains("m"))


def in_season(df: DataFrame, ts: str, months: tuple[int, int] = N.SEASON_MONTHS) -> DataFrame:
    first, last = months
    return df.where(F.month(ref(ts)).isin(*range(first, last + 1)))


def in_months(df: DataFrame, ts: str, months: Sequence[int] = N.SUMMER_MONTHS) -> DataFrame:
    return df.where(F.month(ref(ts)).isin(*months))


def lag_columns(columns: Sequence[str]) -> list[str]:
    prefixes = (N.LEVEL_LAG_PREFIX, N.AIR_LAG_PREFIX, N.FLAG_LAG_PREFIX)
    return [c for c in columns if c.startswith(prefixes)]


def drop_incomplete_lags(df: DataFrame) -> DataFrame:
    subset = lag_columns(df.columns)
    return drop_missing(df, subset) if subset else df


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(ref(c).isNotNull())
    return df


def first_per(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], tiebreak: Sequence[str] = ()
) -> DataFrame:
    """One row for each distinct `by`, with the columns of its first row by `tiebreak`.

    A plain minimum over structs, so a value of `by` that many rows share is reduced on the map
    side instead of being sorted in one task.
    """
    row = F.struct(
        *[ref(c).alias(f"tie{i}") for i, c in enumerate(tiebreak)],
        *[ref(c).alias(f"v{i}") for i, c in enumerate(columns)],
    )
    return (
        df.groupBy(*[ref(c) for c in by])
        .agg(F.min(row).alias("__first"))
        .select(
            *[ref(c) for c in by],
            *[F.col(f"__first.v{i}").alias(c) for i, c in enumerate(columns)],
        )
    )
