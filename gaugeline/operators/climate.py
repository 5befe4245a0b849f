"""Yearly weather analytics: extreme summers and the average year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline import names as N
from gaugeline.functions.time import ref
from gaugeline.operators.clean import in_months


def summer_means(
    df: DataFrame, value: str, *, ts: str = N.DATE, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean of `value` over June to August of each year; years without values are left out."""
    return (
        in_months(df, ts)
        .groupBy(*[ref(k) for k in keys], F.year(ref(ts)).alias("year"))
        .agg(F.avg(ref(value)).alias("summer_mean"))
        .where(F.col("summer_mean").isNotNull())
    )


def best_year(
    df: DataFrame, value: str, *, ts: str = N.DATE, keys: Sequence[str] = ()
) -> DataFrame:
    """The year with the highest summer mean, the earliest of equals; one row for each series.

    A series without any summer value has a missing year.
    """
    summer = F.when(F.month(ref(ts)).isin(*N.SUMMER_MONTHS), ref(value))
    years = df.where(ref(ts).isNotNull()).groupBy(
        *[ref(k) for k in keys], F.year(ref(ts)).alias("year")
    ).agg(F.avg(summer).alias("mean"))
    rank = F.struct(F.col("mean"), (-F.col("year")).alias("back"))
    return (
        years.groupBy(*[ref(k) for k in keys])
        .agg(F.max(F.when(F.col("mean").isNotNull(), rank)).alias("__top"))
        .select(*[ref(k) for k in keys], (-F.col("__top.back")).alias("best_year"))
    )


def best_summer_year_rows(
    df: DataFrame, value: str, *, ts: str = N.DATE, keys: Sequence[str] = ()
) -> DataFrame:
    """All rows, summer or not, of the year whose summer mean of `value` is highest.

    Without keys the year is one number, so it enters the filter as a scalar subquery; with keys the
    one-row-per-series result is joined and Spark broadcasts it only if its measured size allows.
    A series without any summer value raises.
    """
    best = best_year(df, value, ts=ts, keys=keys)
    year = F.coalesce(
        F.col("best_year"),
        F.raise_error(F.lit(f"No values of {value} in June to August.")).cast("int"),
    )
    if not keys:
        return df.where(F.year(ref(ts)) == best.select(year).scalar())
    renamed = best.select(*[ref(k).alias(f"__k{i}") for i, k in enumerate(keys)], year.alias("best_year"))
    match = F.year(ref(ts)) == F.col("best_year")
    for i, k in enumerate(keys):
        match = match & ref(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(renamed, match, "left_semi")


def average_year(
    df: DataFrame,
    values: Sequence[str] = (N.AIR_TEMP, N.HUMIDITY, N.PRESSURE),
    *,
    ts: str = N.DATE,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean of each value over all rows of a calendar slot (month to second), set in a leap year."""
    when = ref(ts)
    parts = {
        "__mo": F.month(when), "__d": F.dayofmonth(when), "__h": F.hour(when),
        "__mi": F.minute(when), "__s": F.second(when),
    }
    slots = (
        df.where(when.isNotNull())
        .groupBy(*[ref(k) for k in keys], *[v.alias(k) for k, v in parts.items()])
        .agg(*[F.avg(ref(c)).alias(c) for c in values])
    )
    day = F.make_date(F.lit(N.REFERENCE_YEAR), F.col("__mo"), F.col("__d"))
    text = F.format_string("%s %02d:%02d:%02d", day.cast("string"), "__h", "__mi", "__s")
    return slots.select(
        *[ref(k) for k in keys],
        text.alias(ts),
        *[ref(c) for c in values],
        F.col("__h").cast("double").alias(N.HOUR),
    )
