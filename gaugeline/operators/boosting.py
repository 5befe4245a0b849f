"""Quantile regression by boosted trees on counted, coded features."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import names as N
from gaugeline.functions.columns import feature_columns, targets
from gaugeline.functions.time import ref
from gaugeline.functions.values import calendar_features, number
from gaugeline.operators.clean import drop_missing
from gaugeline.operators.forest import Goal, Node, boost, plain
from gaugeline.operators.holdout import check_split_sizes, nested_holdout, split_counts, split_weeks
from gaugeline.operators.quantiles import exact_medians
from gaugeline.session import discard, settle

TREE_DEPTH = 5
MAX_BINS = 255
ACCURACY = 10_000


@dataclass
class QuantileModel:
    """What is needed to score, and what training measured."""

    target: str
    features: list[str]
    medians: dict[str, float | None]
    base: float
    trees: list[list[Node]]
    alpha: float
    label: str
    mode: str
    mae: float | None = None
    mae_validation: float | None = None
    rows: dict[str, int] = field(default_factory=dict)


def quantile_alpha(tier: str) -> tuple[str, float]:
    """Label and quantile of a tier; an unknown tier is the middle one."""
    label = tier.strip().lower()
    label = label if label in N.QUANTILE_TIERS else "mid"
    return label, N.QUANTILE_TIERS[label]


def training_table(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    *,
    ts: str,
    tiebreak: Sequence[str] = (),
    require_features: bool = False,
) -> DataFrame:
    """Date, features `x0..`, target `y` and the part (`fit`, `val`, `test`) of each usable row."""
    work = calendar_features(df, ts)
    numeric = work.select(
        ref(ts),
        *[ref(c) for c in tiebreak if c != ts],
        *[number(work, c).alias(f"x{i}") for i, c in enumerate(features)],
        number(work, target).alias("y"),
    )
    needed = ["y"] + [f"x{i}" for i in range(len(features))] * require_features
    return nested_holdout(settle(drop_missing(numeric, needed)), ts=ts, tiebreak=tiebreak)


def predicted(base: float, trees: Sequence[Sequence[Node]], inputs: Sequence[Column]) -> Column:
    """Base value plus all trees, in Arrow batches.

    A few hundred trees as nested CASE exceed what one compiled method may hold and take long to
    plan. Here all rows of a batch walk down a tree together.
    """
    flat = [
        tuple(
            np.array([getattr(n, part) for n in tree])
            for part in ("feature", "threshold", "left", "right", "value")
        )
        for tree in trees
    ]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            cells = batch.to_numpy(dtype=float)
            total = np.full(len(cells), base)
            for feature, threshold, left, right, value in flat:
                at = np.zeros(len(cells), dtype=int)
                going = np.flatnonzero(feature[at] >= 0)
                while len(going):
                    node = at[going]
                    low = cells[going, feature[node]] <= threshold[node]
                    at[going] = np.where(low, left[node], right[node])
                    going = going[feature[at[going]] >= 0]
                total += value[at]
            yield pd.Series(total)

    scorer = F.pandas_udf(run, "double")
    return scorer(F.struct(*[c.alias(f"x{i}") for i, c in enumerate(inputs)]))


def train_quantile(
    df: DataFrame,
    target: str,
    tier: str = "mid",
    *,
    ts: str = N.DATE,
    tiebreak: Sequence[str] = (),
    features: Sequence[str] | None = None,
    rounds: int = N.BOOST_ROUNDS,
    learning_rate: float = N.LEARNING_RATE,
    patience: int = N.PATIENCE,
    depth: int = TREE_DEPTH,
    max_bins: int = MAX_BINS,
    feature_fraction: float = N.FEATURE_FRACTION,
    accuracy: int = ACCURACY,
    seed: int = N.SEED,
    require_features: bool = False,
    mode: str = "pure_weather",
) -> QuantileModel:
    """Train on one target at the quantile of `tier`.

    Features are coded once, by at most `max_bins` cuts each. A round grows one tree on the slope of
    the pinball loss: each level is one pass in which tasks count their rows by node, feature and
    code, and the summed counts, of a fixed size, come to the driver. Each leaf then takes the
    quantile of the residuals in it, times the learning rate; quantiles and cuts are exact to one in
    `accuracy` rows. Training stops once the validation error has not improved for `patience` rounds;
    the best run of trees is kept (see `forest.boost`).
    """
    (model,) = _trained(
        df, target, [tier], ts, tiebreak, features, require_features, mode, rounds=rounds, learning_rate=learning_rate,
        patience=patience, depth=depth, max_bins=max_bins, feature_fraction=feature_fraction, accuracy=accuracy,
        seed=seed)
    return model


def _trained(
    df: DataFrame, target: str, tiers: Sequence[str], ts: str, tiebreak: Sequence[str],
    features: Sequence[str] | None, require_features: bool, mode: str, **schedule,
) -> list[QuantileModel]:
    """Models of one target, one for each tier, on the same rows."""
    if target not in targets(df.columns):
        raise ValueError(f"{target!r} is no level, change or future level of the table.")
    features = list(features or feature_columns(df.columns))
    raw = settle(
        training_table(
            df, target, features, ts=ts, tiebreak=tiebreak, require_features=require_features
        )
    )
    counts = {r["split"]: r["rows"] for r in split_counts(raw).collect()}
    check_split_sizes(counts, 30 if require_features else 0)

    xs = [f"x{i}" for i in range(len(features))]
    found = exact_medians(raw.where(F.col("split") == "fit"), {x: x for x in xs}).first()
    medians = {c: found[x] for c, x in zip(features, xs)}
    usable = [i for i, c in enumerate(features) if medians[c] is not None]
    filled = raw.fillna({xs[i]: medians[features[i]] for i in usable}).fillna(0.0, subset=xs)
    part = (F.array_position(F.array(*[F.lit(p) for p in _PARTS]), F.col("split")) - 1).cast("int")
    n = range(len(tiers))
    table = filled.select(*xs, *[F.col("y").alias(f"y{g}") for g in n], *[part.alias(f"p{g}") for g in n])
    models = _models(table, [target] * len(n), [counts] * len(n), [medians] * len(n), features, usable,
                     [quantile_alpha(t) for t in tiers], mode, **schedule)
    discard(raw)
    return models


_PARTS = ("fit", "val", "test")


def _models(
    table: DataFrame, names: Sequence[str], counts: Sequence[Mapping[str, int]],
    medians: Sequence[Mapping[str, float | None]], features: Sequence[str], usable: Sequence[int],
    tiers: Sequence[tuple[str, float]], mode: str, *, max_bins: int, accuracy: int, **schedule,
) -> list[QuantileModel]:
    """Models of `y0..` from `x0..`, by the parts `p0..`, trained together on the same codes.

    The cuts are quantiles of the features over all rows that any of them is fitted on.
    """
    xs = [f"x{i}" for i in range(len(features))]
    n = range(len(names))
    fit = F.greatest(*[F.col(f"p{g}") == 0 for g in n], F.lit(False))
    points = [(k + 1) / max_bins for k in range(max_bins - 1)]
    measured = table.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.percentile_approx(F.when(F.col(f"p{g}") == 0, F.col(f"y{g}")), tiers[g][1], accuracy).alias(f"y{g}")
          for g in n],
        *[F.percentile_approx(F.when(fit, F.col(x)), points, accuracy).alias(x) for x in xs],
    ).first()
    cuts = [np.unique(np.array(measured[x], dtype=float)) for x in xs]
    goals = [Goal(tiers[g][1], float(measured[f"y{g}"])) for g in n]
    boost(table, cuts, usable, goals, measured["rows"], accuracy=accuracy, **schedule)
    return [
        QuantileModel(name, list(features), dict(medians[g]), goals[g].base,
                      [[plain(node, cuts) for node in tree] for tree in goals[g].trees], tiers[g][1], tiers[g][0], mode,
                      goals[g].mae, goals[g].mae_validation, dict(counts[g]))
        for g, name in enumerate(names)
    ]


def train_tiers(
    df: DataFrame, target: str, tiers: Sequence[str] = tuple(N.QUANTILE_TIERS), *, ts: str = N.DATE,
    tiebreak: Sequence[str] = (), features: Sequence[str] | None = None, rounds: int = N.BOOST_ROUNDS,
    learning_rate: float = N.LEARNING_RATE, patience: int = N.PATIENCE, depth: int = TREE_DEPTH,
    max_bins: int = MAX_BINS, feature_fraction: float = N.FEATURE_FRACTION, accuracy: int = ACCURACY,
    seed: int = N.SEED, require_features: bool = False, mode: str = "pure_weather", shared: bool = False,
) -> dict[str, QuantileModel]:
    """Models of one target at several quantiles, trained in the same passes.

    Each equals the model that `train_quantile` gives. With `shared`, all have the same splits, each
    its own values in the leaves: what they say of a row then comes from the same rows. Either way
    `scoring.score_tiers` puts what they say of a row in order.
    """
    models = _trained(
        df, target, tiers, ts, tiebreak, features, require_features, mode, rounds=rounds, learning_rate=learning_rate,
        patience=patience, depth=depth, max_bins=max_bins, feature_fraction=feature_fraction, accuracy=accuracy,
        seed=seed, shared=shared)
    return dict(zip(tiers, models))


def train_targets(
    df: DataFrame, wanted: Sequence[str] | None = None, *, ts: str = N.DATE, tiebreak: Sequence[str] = (),
    rounds: int = N.BOOST_ROUNDS, learning_rate: float = N.LEARNING_RATE, patience: int = N.PATIENCE,
    depth: int = TREE_DEPTH, max_bins: int = MAX_BINS, feature_fraction: float = N.FEATURE_FRACTION,
    accuracy: int = ACCURACY, seed: int = N.SEED, mode: str = "pure_weather",
) -> tuple[list[QuantileModel], Mapping[str, str]]:
    """Train the middle quantile for each target; a target that fails is left out and reported.

    Lags may be absent here, and a row needs its target and all of its features. The features are
    read and coded once, and all targets grow their trees in the same passes, each with its own rows,
    its own week split and its own stopping. A target with too few weeks is split by rows and
    trained by itself.
    """
    names = [t for t in (wanted or targets(df.columns, by_length=True)) if t in df.columns]
    if not names:
        raise ValueError("No targets in the table.")
    features = feature_columns(df.columns, lags_required=False)
    known = set(targets(df.columns))
    failures = {name: f"ValueError: {name!r} is no level, change or future level of the table."
                for name in names if name not in known}
    names = [name for name in dict.fromkeys(names) if name in known]
    schedule = dict(max_bins=max_bins, accuracy=accuracy, rounds=rounds, learning_rate=learning_rate,
                    patience=patience, depth=depth, feature_fraction=feature_fraction, seed=seed)
    work = calendar_features(df, ts)
    xs = [f"x{i}" for i in range(len(features))]
    rows = settle(drop_missing(work.select(
        ref(ts).alias("__ts"), *[number(work, c).alias(x) for c, x in zip(features, xs)],
        *[number(work, name).alias(f"y{g}") for g, name in enumerate(names)]), xs)) if names else None
    parts = split_weeks(rows, [f"y{g}" for g in range(len(names))], ts="__ts") if names else []
    together, by_rows = [], []
    for g, name in enumerate(names):
        if parts[g] is None:
            by_rows.append(name)
            continue
        try:
            check_split_sizes(parts[g].rows, 30)
            together.append(g)
        except ValueError as error:
            failures[name] = f"{type(error).__name__}: {error}"
    trained: dict[str, QuantileModel] = {}
    if together:
        table = rows.select(*xs, *[F.col(f"y{g}").alias(f"y{i}") for i, g in enumerate(together)],
                            *[F.coalesce(parts[g].number, F.lit(-1)).alias(f"p{i}") for i, g in enumerate(together)])
        table = settle(table.where(F.greatest(*[F.col(f"p{i}") for i in range(len(together))], F.lit(-1)) >= 0))
        medians = _medians(table, xs, features, len(together))
        models = _models(table, [names[g] for g in together], [parts[g].rows for g in together], medians, features,
                         range(len(features)), [quantile_alpha("mid")] * len(together), mode, **schedule)
        trained |= {m.target: m for m in models}
        discard(table)
    for name in by_rows:
        try:
            trained[name] = train_quantile(df, name, "mid", ts=ts, tiebreak=tiebreak, features=features,
                                           require_features=True, mode=mode, **schedule)
        except Exception as error:  # noqa: BLE001 - one target's failure must not lose the others
            failures[name] = f"{type(error).__name__}: {error}"
    if rows is not None:
        discard(rows)
    return [trained[name] for name in names if name in trained], failures


def _medians(
    table: DataFrame, xs: Sequence[str], features: Sequence[str], goals: int
) -> list[dict[str, float | None]]:
    """Exact medians of the features over the fit rows of each goal, all in the same passes."""
    masked = {f"{x}_{g}": F.when(F.col(f"p{g}") == 0, F.col(x)) for g in range(goals) for x in xs}
    found = exact_medians(table.select(*[c.alias(n) for n, c in masked.items()]), {n: n for n in masked}).first()
    return [{c: found[f"{x}_{g}"] for c, x in zip(features, xs)} for g in range(goals)]
