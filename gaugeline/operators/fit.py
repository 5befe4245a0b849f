"""Straight-line fit of a value against the time of day, one for each day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline import names as N
from gaugeline.functions.time import ref
from gaugeline.functions.values import hours_of_day


def daily_fit(
    df: DataFrame, *, ts: str, value: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Points, slope, intercept, r² and time range of the finite points of each day.

    One partial and one final aggregation; a hot day is reduced on the map side. Fewer than two
    points, or all at one time of day, give no fit; a constant value has r² 0.
    """
    y = ref(value).cast("double")
    finite = y.isNotNull() & ~F.isnan(y) & (F.abs(y) != F.lit(float("inf")))
    points = df.where(ref(ts).isNotNull()).select(
        *[ref(k) for k in keys],
        ref(ts).cast("date").alias("__day"),
        F.when(finite, hours_of_day(ref(ts))).alias("__x"),
        F.when(finite, y).alias("__y"),
    )
    yv, xv = F.col("__y"), F.col("__x")
    fitted = points.groupBy(*[ref(k) for k in keys], "__day").agg(
        F.count(yv).alias("n_points"),
        F.regr_slope(yv, xv).alias("__slope"),
        F.regr_intercept(yv, xv).alias("__intercept"),
        F.regr_r2(yv, xv).alias("__r2"),
        F.min(xv).alias("time_start_h"),
        F.max(xv).alias("time_end_h"),
        (F.min(yv) == F.max(yv)).alias("__flat"),
    )
    enough = (F.col("n_points") >= 2) & (F.col("time_start_h") < F.col("time_end_h"))
    return fitted.select(
        *[ref(k) for k in keys],
        F.col("__day").cast("string").alias("date"),
        "n_points",
        F.when(enough, F.col("__slope")).alias("slope_DO_per_hour"),
        F.when(enough, F.col("__intercept")).alias("intercept"),
        F.when(enough, F.when(F.col("__flat"), F.lit(0.0)).otherwise(F.col("__r2")))
        .alias("r_squared"),
        "time_start_h",
        "time_end_h",
    )


def append_fit_summary(fits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add the row with the sum of points and the unweighted mean of the daily slopes.

    Each day is counted once under its own name and once under the label of the summary, so the
    readings are aggregated once; a day on its own is its own sum and mean.
    """
    own = F.col("date") != N.SUMMARY_LABEL
    named = fits.withColumn("date", F.explode(F.array("date", F.lit(N.SUMMARY_LABEL))))
    columns = ("intercept", "r_squared", "time_start_h", "time_end_h")
    return named.groupBy(*[ref(k) for k in keys], "date").agg(
        F.sum("n_points").alias("n_points"),
        F.avg("slope_DO_per_hour").alias("slope_DO_per_hour"),
        *[F.max(F.when(own, F.col(c))).alias(c) for c in columns],
    )
