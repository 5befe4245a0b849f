"""Which hours and days a series covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.time import ref


def hour_mask(ts: Column) -> Column:
    """The distinct hours of the rows as the bits of one integer, so a group stays one number."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), F.hour(ts)))


def _hour_is_set(mask: Column, hour: Column) -> Column:
    return F.call_function("shiftright", mask, hour).bitwiseAND(F.lit(1)) == 1


def missing_hours(mask: Column) -> Column:
    """The hours 0 to 23 that are not in the mask, in order."""
    return F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: ~_hour_is_set(mask, h))


def longest_hour_run(mask: Column) -> Column:
    """The longest run of consecutive hours in the mask; 0 for an empty one."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, hour: Column) -> Column:
        run = F.when(_hour_is_set(mask, hour), acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(23)), start, step, lambda acc: acc["best"])


def daily_coverage(df: DataFrame, *, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, first and last time, hours with and without data and the longest run, for each day."""
    when = ref(ts)
    mask = F.col("__hours")
    days = (
        df.where(when.isNotNull())
        .groupBy(*[ref(k) for k in keys], when.cast("date").alias("calendar_date"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min(when).alias("first_datetime"),
            F.max(when).alias("last_datetime"),
            hour_mask(when).alias("__hours"),
        )
    )
    covered = F.bit_count(mask)
    return days.select(
        *[ref(k) for k in keys],
        "calendar_date",
        "row_count",
        "first_datetime",
        "last_datetime",
        covered.alias("distinct_hours_with_data"),
        (F.lit(24) - covered).alias("hours_missing_in_day"),
        F.array_join(missing_hours(mask).cast("array<string>"), ",").alias("missing_hours_list"),
        longest_hour_run(mask).alias("longest_consecutive_hour_streak_in_day"),
    )


def day_blocks(
    days: DataFrame, *, day: str = "calendar_date", keys: Sequence[str] = ()
) -> DataFrame:
    """Runs of consecutive calendar days, with the gap to the next run (missing on the last).

    The windows run over distinct days, at most one row for each day of the time span.
    """
    series = [ref(k) for k in keys]
    distinct = days.where(ref(day).isNotNull()).select(
        *series, ref(day).cast("date").alias("__day")
    ).distinct()
    order = Window.partitionBy(*series).orderBy("__day")
    island = F.date_sub(F.col("__day"), F.row_number().over(order))
    blocks = (
        distinct.withColumn("__island", island)
        .groupBy(*series, "__island")
        .agg(F.min("__day").alias("start_date"), F.max("__day").alias("end_date"))
    )
    chain = Window.partitionBy(*series).orderBy("start_date")
    length = F.date_diff("end_date", "start_date") + 1
    return blocks.select(
        *series,
        F.row_number().over(chain).alias("block_id"),
        "start_date",
        "end_date",
        length.alias("consecutive_calendar_days"),
        F.call_function("div", length, F.lit(7)).cast("int").alias("whole_weeks_in_block"),
        (length % 7).alias("remainder_days_after_full_weeks"),
        (F.date_diff(F.lead("start_date").over(chain), F.col("end_date")) - 1).alias(
            "gap_calendar_days_before_next_block"
        ),
    )
