"""Finding columns by name. Only `df.columns` is read; no job runs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from gaugeline import names as N
from gaugeline.functions.time import ref


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def date_column(columns: Sequence[str], wanted: str | None = None) -> str:
    """The wanted column if present, else `DATE`, else the first column."""
    for name in (wanted, N.DATE):
        if name and name in columns:
            return name
    return columns[0]


def level_column(columns: Sequence[str], wanted: str | None = None) -> str | None:
    """The wanted column if present, else `DO`, else the first whose name contains "do"."""
    for name in (wanted, N.LEVEL):
        if name and name in columns:
            return name
    return next((c for c in columns if N.LEVEL.lower() in c.lower()), None)


def flag_column(columns: Sequence[str]) -> str | None:
    return next((c for c in columns if N.FLAG_HINT in c.lower()), None)


def select_aliases(
    df: DataFrame, aliases: Mapping[str, Iterable[str]] = N.WEATHER_ALIASES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Keep and rename the columns of `aliases`, matched without case; `keep` columns stay."""
    by_lower = {c.strip().lower(): c for c in df.columns}
    picked = []
    for out, accepted in aliases.items():
        source = next((by_lower[a] for a in accepted if a in by_lower), None)
        if source is None:
            raise ValueError(f"No column for {out!r}: need one of {tuple(accepted)}, "
                             f"found {df.columns}")
        picked.append(ref(source).alias(out))
    return df.select(*[ref(k) for k in keep], *picked)


def is_future_level(name: str) -> bool:
    return re.fullmatch(N.FUTURE_LEVEL_PATTERN, name.strip()) is not None


def targets(columns: Sequence[str], by_length: bool = False) -> list[str]:
    """Trainable columns: the level, its changes, its future levels.

    Changes and levels are sorted by name, or by (length, name), which puts `6h` before `12h`.
    """
    order = (lambda c: (len(c), c)) if by_length else None
    changes = sorted((c for c in columns if c.startswith(N.DELTA_PREFIX)), key=order)
    futures = sorted((c for c in columns if is_future_level(c)), key=order)
    return [c for c in (N.LEVEL,) if c in columns] + changes + futures


def feature_columns(columns: Sequence[str], lags_required: bool = True) -> list[str]:
    """Weather, calendar and air-temperature lag columns a model is trained on.

    The first complete lag group wins, else every air lag present. The calendar columns are
    derived from the date and need not be there yet.
    """
    lags = next((list(g) for g in N.AIR_LAG_GROUPS if all(c in columns for c in g)), None)
    if lags is None:
        lags = [c for c in columns if c.startswith(N.AIR_LAG_PREFIX)]
    if lags_required and not lags:
        raise ValueError(f"No {N.AIR_LAG_PREFIX}* columns; expected one of {N.AIR_LAG_GROUPS}")
    missing = [c for c in N.WEATHER_FEATURES if c not in columns]
    if missing:
        raise ValueError(f"Missing feature columns: {missing}")
    return [*N.WEATHER_FEATURES, *N.CALENDAR_FEATURES, *lags]


def prediction_column(target: str, label: str | None = None, weather_only: bool = False) -> str:
    if weather_only:
        return f"pred_{target}_weather_only"
    return f"pred_{target}_quantile_{label}" if label else f"pred_{target}"


def reorder(df: DataFrame, head: Sequence[str], tail: Sequence[str] = ()) -> DataFrame:
    """`head`, then `tail`, then whatever else there is; absent names are skipped."""
    first = [c for c in [*head, *tail] if c in df.columns]
    return df.select(*[ref(c) for c in first + [c for c in df.columns if c not in first]])


def insert_after(df: DataFrame, moved: Sequence[str], anchor: str) -> DataFrame:
    """Move columns behind the leading pair that holds `anchor`, or behind the first column."""
    moved = [c for c in moved if c in df.columns]
    rest = [c for c in df.columns if c not in moved]
    at = 2 if anchor in rest else 1
    return df.select(*[ref(c) for c in rest[:at] + moved + rest[at:]])


def drop_matching(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Drop the columns whose whole name matches, but for those in `keep`."""
    return df.drop(*[c for c in df.columns if re.fullmatch(pattern, c) and c not in keep])
