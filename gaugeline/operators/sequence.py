"""Operators on the row order of a series: previous row, fills, positions, runs, spacing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.functions.time import ref
from gaugeline.operators.quantiles import exact_medians
from gaugeline.plans.timeline import (
    CARRY, DEFAULT_BUCKET, POS, Carry, Lookup, bucketed, fold_last, look_up, row_order, with_carries,
)


def _last(columns: Sequence[str], tiebreak: Sequence[str]) -> Column:
    return F.struct(
        F.col(POS).alias("at"),
        *[ref(c).alias(f"tie{i}") for i, c in enumerate(tiebreak)],
        *[ref(c).alias(f"v{i}") for i, c in enumerate(columns)],
    )


def _neighbours(
    df: DataFrame,
    columns: Sequence[str],
    *,
    ts: str,
    keys: Sequence[str],
    tiebreak: Sequence[str],
    bucket: str | int,
    following: bool = False,
    index: bool = False,
) -> DataFrame:
    """Rows with struct `__prev` (and `__next`) holding position and `columns` of the neighbours.

    `__index` is the place of the row in its series, from 0.
    """
    rows = bucketed(df, ts, keys, bucket)
    mine = _last(columns, tiebreak)
    values, ties = [ref(c) for c in columns], [ref(c) for c in tiebreak]
    kinds = [df.schema[c].dataType for c in tiebreak]
    every = F.lit(True)
    carries = [Carry("__before", fold_last(every, values, ties, kinds), F.max)]
    if following:
        carries.append(Carry("__after", fold_last(every, values, ties, kinds, first=True), F.min, "after"))
    if index:
        carries.append(Carry("__count", F.count(F.lit(1)), F.sum))
    laid = with_carries(rows, carries, keys)
    order = row_order(keys, tiebreak)
    part = Window.partitionBy(*[ref(k) for k in keys], F.col("__bucket"))
    shown = F.when(F.col(CARRY), F.col("__before")).otherwise(mine)
    out = [ref(c) for c in df.columns] + [F.col(POS), F.col("__bucket")]
    added = [F.lag(shown).over(order).alias("__prev")]
    if following:
        # Past the last real row of the bucket the neighbour from the carry row takes over.
        after = F.max("__after").over(part)
        added.append(F.coalesce(F.lead(mine).over(order), after).alias("__next"))
    if index:
        counted = F.when(F.col(CARRY), F.coalesce(F.col("__count"), F.lit(0))).otherwise(1)
        running = F.sum(counted).over(order.rowsBetween(Window.unboundedPreceding, 0))
        added.append((running - 1).alias("__index"))
    names = ["__prev"] + ["__next"] * following + ["__index"] * index
    return laid.select("*", *added).where(~F.col(CARRY)).select(*out, *names)


def row_index(
    df: DataFrame,
    out: str,
    *,
    ts: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Place of each row in its series, counted from 0 in time order."""
    rows = bucketed(df, ts, keys, bucket)
    laid = with_carries(rows, [Carry("__count", F.count(F.lit(1)), F.sum)], keys)
    counted = F.when(F.col(CARRY), F.coalesce(F.col("__count"), F.lit(0))).otherwise(1)
    running = F.sum(counted).over(
        row_order(keys, tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        laid.withColumn("__running", running)
        .where(~F.col(CARRY))
        .select(*[ref(c) for c in df.columns if c != out], (F.col("__running") - 1).alias(out))
    )


def mark_transitions(
    df: DataFrame,
    flag: str,
    out: str = "transition",
    *,
    ts: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """True where the flag differs from the row before; a missing flag counts as 0."""
    rows = _neighbours(
        df, [flag], ts=ts, keys=keys, tiebreak=tiebreak, bucket=bucket
    )
    zero = F.lit(0.0)
    changed = F.coalesce(ref(flag), zero) != F.coalesce(F.col("__prev.v0"), zero)
    return rows.select(
        *[ref(c) for c in df.columns if c != out],
        (F.col("__prev").isNotNull() & changed).alias(out),
    )


def spacing(
    df: DataFrame,
    out: str = "spacing_minutes",
    *,
    ts: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Minutes since the row before; missing on the first row of a series."""
    rows = bucketed(df, ts, keys, bucket)
    laid = with_carries(rows, [Carry("__before", F.max(POS), F.max)], keys)
    before = F.lag(F.coalesce(F.col("__before"), F.col(POS))).over(row_order(keys, tiebreak))
    gap = (F.col(POS) - F.col("__prev")) / F.lit(60_000_000.0)
    return (
        laid.withColumn("__prev", before)
        .where(~F.col(CARRY))
        .select(*[ref(c) for c in df.columns if c != out], gap.alias(out))
    )


def median_spacing(
    df: DataFrame,
    out: str = "median_minutes",
    *,
    ts: str,
    keys: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Exact median of the minutes between neighbouring rows, one row for each series."""
    times = df.select(*[ref(c) for c in dict.fromkeys([ts, *keys])])
    gaps = spacing(times, "__gap", ts=ts, keys=keys, bucket=bucket)
    return exact_medians(gaps, {"__gap": out}, keys=keys)


def fill_both_ways(
    df: DataFrame,
    columns: Sequence[str],
    *,
    ts: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Missing values take the last value before them; leading ones the first value after them."""
    rows = bucketed(df, ts, keys, bucket)
    carries = []
    ties, kinds = [ref(c) for c in tiebreak], [df.schema[c].dataType for c in tiebreak]
    for i, c in enumerate(columns):
        known = ref(c).isNotNull()
        carries.append(Carry(f"__last{i}", fold_last(known, [ref(c)], ties, kinds), F.max))
        carries.append(
            Carry(f"__head{i}", fold_last(known, [ref(c)], ties, kinds, first=True), F.min, "all"))
    laid = with_carries(rows, carries, keys)
    upto = row_order(keys, tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    filled = {}
    for i, c in enumerate(columns):
        shown = F.when(F.col(CARRY), F.col(f"__last{i}.v0")).otherwise(ref(c))
        head = F.first(F.col(f"__head{i}.v0"), ignorenulls=True).over(upto)
        filled[c] = F.coalesce(F.last(shown, ignorenulls=True).over(upto), head)
    return (
        laid.select("*", *[v.alias(f"__f{i}") for i, v in enumerate(filled.values())])
        .where(~F.col(CARRY))
        .select(
            *[
                F.col(f"__f{list(columns).index(c)}").alias(c) if c in filled else ref(c)
                for c in df.columns
            ]
        )
    )


def true_runs(
    df: DataFrame,
    flag: str,
    *,
    ts: str,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    bucket: str | int = DEFAULT_BUCKET,
    rows_per_bucket: int = 1_000_000,
) -> DataFrame:
    """Stretches of rows whose flag is true, as half-open index ranges `[start, end)`.

    Only the first and last row of each run are kept; each first row finds its last row by
    position, so a run may span any number of buckets.
    """
    named = df.select(
        *[ref(c) for c in dict.fromkeys([*keys, ts, *tiebreak])],
        F.coalesce(ref(flag).cast("boolean"), F.lit(False)).alias("__on"),
    )
    rows = _neighbours(
        named, ["__on"], ts=ts, keys=keys, tiebreak=tiebreak, bucket=bucket,
        following=True, index=True,
    )
    off = F.lit(False)
    starts = ~F.coalesce(F.col("__prev.v0"), off)
    ends = ~F.coalesce(F.col("__next.v0"), off)
    edges = (
        rows.where(F.col("__on") & (starts | ends))
        .select(*[ref(k) for k in keys], ref(ts), F.col("__index"), starts.alias("__starts"),
                ends.alias("__ends"), ref(ts).alias("__end_ts"), F.col("__index").alias("__stop"))
    )
    paired = look_up(
        edges, ts="__index", sources=["__stop", "__end_ts"], lookups=[Lookup("__last", 0, True)],
        keys=keys, where=F.col("__ends"), bucket=rows_per_bucket,
    )
    stop = F.col("__last").getField("__stop") + 1
    return paired.where("__starts").select(
        *[ref(k) for k in keys],
        F.col("__index").alias("start"),
        stop.alias("end"),
        (stop - F.col("__index")).alias("length"),
        ref(ts).alias("start_ts"),
        F.col("__last").getField("__end_ts").alias("end_ts"),
    )
