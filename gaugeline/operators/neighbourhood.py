"""Rows close in time to a transition, and joins on time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeline import names as N
from gaugeline.functions.time import HOUR_MICROS, position, ref
from gaugeline.operators.clean import first_per
from gaugeline.plans.timeline import DEFAULT_BUCKET, Lookup, look_up


def near_events(
    df: DataFrame,
    event: str,
    hours: int = N.TRANSITION_REACH_HOURS,
    *,
    ts: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Rows within `hours` (inclusive) before or after a row whose `event` is true.

    Each row looks up the last event before it and the first after it, in one shuffle, so the
    number of events does not multiply the work.
    """
    found = look_up(
        df,
        ts=ts,
        lookups=[Lookup("__last", 0), Lookup("__next", 0, forward=True)],
        keys=keys,
        tiebreak=tiebreak,
        where=ref(event),
        bucket=bucket,
    )
    here, reach = position(found, ts), F.lit(hours * HOUR_MICROS)
    close = (here - F.col("__last.at") <= reach) | (F.col("__next.at") - here <= reach)
    return found.where(close).select(*[ref(c) for c in df.columns])


def join_first_at_time(
    left: DataFrame,
    right: DataFrame,
    columns: Sequence[str],
    *,
    ts: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Join `left` with the first row of `right` at the same time; left rows are not multiplied."""
    plain = left.drop(*columns)
    firsts = first_per(right, [*keys, ts], columns, tiebreak)
    firsts = firsts.toDF(*[f"__j{i}" for i in range(len(keys) + 1)], *columns)
    match = ref(ts) == F.col(f"__j{len(keys)}")
    for i, k in enumerate(keys):
        match = match & ref(k).eqNullSafe(F.col(f"__j{i}"))
    joined = plain.join(firsts, match, how)
    return joined.select(*[ref(c) for c in plain.columns], *[ref(c) for c in columns])


def pair_predictions(
    changes: DataFrame,
    levels: DataFrame,
    columns: Sequence[str],
    *,
    ts: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Bring the `columns` of `levels` to the rows of `changes` at the same (series, time).

    With `tiebreak`, columns that both sides have, rows that share a time pair in that order. A row
    that has no partner on the other side raises; without `tiebreak` so does a time that `levels`
    holds twice.
    """
    by = [*keys, ts]
    names = changes.columns
    if tiebreak:
        place = F.row_number().over(
            Window.partitionBy(*[ref(c) for c in by]).orderBy(*[ref(c) for c in tiebreak]))
        changes, levels = (df.withColumn("__place", place) for df in (changes, levels))
        by = [*by, "__place"]
    right = levels.groupBy(*[ref(c) for c in by]).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.max(ref(c)).alias(f"__p{i}") for i, c in enumerate(columns)],
    )
    right = right.toDF(*[f"__j{i}" for i in range(len(by))], "__rows",
                       *[f"__p{i}" for i in range(len(columns))])
    match = F.lit(True)
    for i, c in enumerate(by):
        match = match & ref(c).eqNullSafe(F.col(f"__j{i}"))
    joined = changes.withColumn("__here", F.lit(True)).join(right, match, "full_outer")
    paired = F.col("__here").isNotNull() & (F.col("__rows") == 1)
    checked = F.when(paired, F.lit(True)).otherwise(
        F.raise_error(F.lit("The two prediction tables do not pair up row by row."))
        .cast("boolean")
    )
    return joined.where(checked).select(
        *[ref(c) for c in names],
        *[F.col(f"__p{i}").alias(c) for i, c in enumerate(columns)],
    )
