"""Chronological splits that keep whole ISO weeks together."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import names as N
from gaugeline.functions.time import ref
from gaugeline.operators.sequence import row_index
from gaugeline.plans.timeline import DEFAULT_BUCKET


def week_key(ts: Column) -> Column:
    """ISO year and week, unpadded: `2024-W5`."""
    year, week = F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts)
    return F.concat(year.cast("string"), F.lit("-W"), week.cast("string"))


def week_start(ts: Column) -> Column:
    """Monday 00:00 of the ISO week."""
    return F.date_trunc("WEEK", ts).cast("timestamp_ntz")


def _weeks(df: DataFrame, ts: str) -> list[datetime]:
    """The weeks with data, in order: at most 53 for each year of the time span."""
    found = df.where(ref(ts).isNotNull()).select(week_start(ref(ts)).alias("w")).distinct()
    return sorted(r.w for r in found.toLocalIterator())


def _held_out(weeks: int, ratio: float) -> int:
    return max(1, math.ceil(weeks * ratio))


def split_by_week(
    df: DataFrame,
    ratios: Mapping[str, float],
    rest: str,
    *,
    ts: str,
    tiebreak: Sequence[str] = (),
    out: str = "split",
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """Name the part of each row: the last weeks go to the first name of `ratios`, the last weeks
    of what remains to the second, and so on; the earliest rows are `rest`.

    With fewer than 3 weeks left, a part takes the last rows by fraction instead. Parts of whole
    weeks are told apart by comparing the time with a constant, so a filter on one part reaches
    the scan; only the split by rows numbers them.
    """
    dated = df.where(ref(ts).isNotNull())
    weeks = _weeks(dated, ts)
    tests: list[tuple[Column, str]] = []
    rows_left: int | None = None
    for name, ratio in ratios.items():
        if rows_left is None and len(weeks) >= N.MIN_WEEKS:
            kept = len(weeks) - _held_out(len(weeks), ratio)
            start = weeks[kept].strftime("%Y-%m-%d %H:%M:%S")
            tests.append((ref(ts) >= F.lit(start).cast("timestamp_ntz"), name))
            weeks = weeks[:kept]
            continue
        if rows_left is None:
            remaining = dated
            for held, _ in tests:
                remaining = remaining.where(~held)
            rows_left = remaining.count()
        rows_left = int(rows_left * (1.0 - ratio))
        tests.append((F.col("__place") >= rows_left, name))
    if rows_left is not None:
        dated = row_index(dated, "__place", ts=ts, tiebreak=tiebreak, bucket=bucket)
    part = F.lit(rest)
    for held, name in reversed(tests):
        part = F.when(held, F.lit(name)).otherwise(part)
    return dated.select(*[ref(c) for c in df.columns if c != out], part.alias(out))


def holdout(
    df: DataFrame,
    ratio: float = N.TEST_RATIO,
    *,
    ts: str,
    tiebreak: Sequence[str] = (),
    out: str = "split",
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """`train` and `test`."""
    return split_by_week(
        df, {"test": ratio}, "train", ts=ts, tiebreak=tiebreak, out=out, bucket=bucket
    )


def nested_holdout(
    df: DataFrame,
    *,
    ts: str,
    tiebreak: Sequence[str] = (),
    out: str = "split",
    bucket: str | int = DEFAULT_BUCKET,
) -> DataFrame:
    """`test` 30 %, then `val` 20 % of the remaining weeks, else `fit`."""
    return split_by_week(
        df, {"test": N.TEST_RATIO, "val": N.VALIDATION_RATIO}, "fit",
        ts=ts, tiebreak=tiebreak, out=out, bucket=bucket,
    )


@dataclass(frozen=True)
class WeekParts:
    """The part of a row (0 fit, 1 val, 2 test; null where the value is missing) and rows by name."""

    number: Column
    rows: dict[str, int]


def split_weeks(df: DataFrame, values: Sequence[str], *, ts: str) -> list[WeekParts | None]:
    """The nested split of `nested_holdout` for the rows that have each of the values, in one pass.

    None for a value with too few weeks, which is split by rows.
    """
    week = week_start(ref(ts))
    found = df.where(ref(ts).isNotNull()).groupBy(week.alias("w")).agg(
        *[F.count(ref(v)).alias(f"n{i}") for i, v in enumerate(values)]).collect()
    out: list[WeekParts | None] = []
    for i, value in enumerate(values):
        rows = {r["w"]: r[f"n{i}"] for r in found if r[f"n{i}"]}
        weeks, starts = sorted(rows), []
        for ratio in (N.TEST_RATIO, N.VALIDATION_RATIO):
            if len(weeks) >= N.MIN_WEEKS:
                kept = len(weeks) - _held_out(len(weeks), ratio)
                starts.append(weeks[kept])
                weeks = weeks[:kept]
        if len(starts) < 2:
            out.append(None)
            continue
        test, val = (F.lit(s.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz") for s in starts)
        number = F.when(ref(ts) >= test, 2).when(ref(ts) >= val, 1).otherwise(0)
        counts = dict.fromkeys(("fit", "val", "test"), 0)
        for w, n in rows.items():
            counts["test" if w >= starts[0] else "val" if w >= starts[1] else "fit"] += n
        out.append(WeekParts(F.when(ref(value).isNotNull() & ref(ts).isNotNull(), number), counts))
    return out


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(ref(split)).agg(F.count(F.lit(1)).alias("rows"))


def check_split_sizes(counts: Mapping[str, int], least_rows: int = 0) -> None:
    """Raise if a nested split is too small to train, validate or test on."""
    # Least rows of each part.
    least = {"train": 20, "test": 10, "fit": 10, "val": 5}
    have = {name: counts.get(name, 0) for name in ("fit", "val", "test")}
    have["train"] = have["fit"] + have["val"]
    if have["train"] + have["test"] < least_rows:
        raise ValueError(f"Need {least_rows} rows, have {have['train'] + have['test']}.")
    for name, rows in least.items():
        if have[name] < rows:
            raise ValueError(f"Need {rows} {name} rows, have {have[name]}.")
