"""Rounds of several goals at once against boosting written out plainly."""

import math
import pickle
import random

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from gaugeline import names as N
from gaugeline.operators import forest
from gaugeline.operators.boosting import train_quantile, train_targets
from gaugeline.operators.forest import Goal, Node
from gaugeline.operators.holdout import nested_holdout, split_counts, split_weeks


def plain_boost(x, y, part, cuts, alpha, base, rounds, rate, patience, depth, fraction, seed):
    """One goal: every split by looking at all rows of a node."""
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    picker, take = random.Random(seed), max(1, round(x.shape[1] * fraction))
    score, trees, best, size = np.full(len(y), base), [], math.inf, 0
    for done in range(rounds + 1):
        chosen = sorted(picker.sample(range(x.shape[1]), take)) if done < rounds else []
        error = np.abs(y - score)[part == 1].mean()
        if error < best * (1 - 1e-12):
            best, size = error, done
        elif done - size >= patience:
            break
        if done == rounds:
            break
        tree, where, level, leaves = [Node(-1, 0.0, -1, -1, 0.0)], np.zeros(len(y), int), [0], 1
        for _ in range(depth):
            found = []
            for node in level:
                rows = np.flatnonzero((where == node) & (part == 0))
                slope = (y[rows] > score[rows]) - (1 - alpha)
                top = (1e-9, None, None)
                for f in chosen:
                    for k in range(len(cuts[f])):
                        low = codes[rows, f] <= k
                        n = low.sum()
                        if n < 20 or len(rows) - n < 20:
                            continue
                        gain = (slope[low].sum() ** 2 / n + slope[~low].sum() ** 2 / (len(rows) - n)
                                - slope.sum() ** 2 / len(rows))
                        if gain > top[0] + 1e-9:
                            top = (gain, f, k)
                if top[1] is not None:
                    found.append((top, node))
            level = []
            for (_, f, k), node in sorted(found, key=lambda s: (-round(s[0][0], 9), s[1])):
                if leaves < N.TREE_LEAVES:
                    at = len(tree)
                    tree += [Node(-1, 0.0, -1, -1, 0.0)] * 2
                    tree[node] = Node(f, float(k), at, at + 1, 0.0)
                    inside = where == node
                    where[inside] = np.where(codes[inside, f] <= k, at, at + 1)
                    level += [at, at + 1]
                    leaves += 1
        for i, node in enumerate(tree):
            if node.feature < 0:
                own = np.sort((y - score)[(where == i) & (part == 0)])
                value = own[max(math.ceil(alpha * len(own) - 1e-9), 1) - 1] if len(own) else 0.0
                tree[i] = Node(-1, 0.0, -1, -1, rate * float(value))
        score = score + np.array([n.value for n in tree])[where]
        trees.append(tree)
    return trees[: max(1, size)], best


def data(n=900, seed=7):
    rng = np.random.RandomState(seed)
    x = np.column_stack([rng.normal(size=n), rng.randint(0, 6, n), rng.uniform(size=n)])
    ys = [x[:, 0] * 2 + x[:, 1] + rng.normal(size=n), np.sin(5 * x[:, 2]) + rng.normal(size=n) / 3, rng.normal(size=n)]
    parts = [rng.choice([0, 0, 0, 1, 2, -1], n) for _ in ys]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 20)[1:-1], method="lower")) for f in range(3)]
    return x, ys, parts, cuts


def frame(spark, x, ys, parts):
    rows = [(*map(float, x[i]), *(float(y[i]) if p[i] >= 0 else None for y, p in zip(ys, parts)),
             *(int(p[i]) for p in parts)) for i in range(len(x))]
    return spark.createDataFrame(rows, ", ".join(
        [f"x{i} double" for i in range(x.shape[1])] + [f"y{g} double" for g in range(len(ys))]
        + [f"p{g} int" for g in range(len(ys))]))


@pytest.mark.parametrize("many_tasks", [False, True])
def test_goals_grow_as_they_would_alone(spark, monkeypatch, many_tasks):
    x, ys, parts, cuts = data()
    monkeypatch.setattr(forest, "ROUNDS_PER_TABLE", 2)
    monkeypatch.setattr(forest, "ROWS_PER_TASK", 150)
    if many_tasks:
        monkeypatch.setattr(forest, "MOST_PARTIALS", 2)
        monkeypatch.setattr(forest, "_KNOWN_BYTES", 0)
    alphas = [0.5, 0.9, 0.1]
    bases = [float(np.quantile(y[p == 0], a, method="lower")) for y, p, a in zip(ys, parts, alphas)]
    goals = [Goal(a, b) for a, b in zip(alphas, bases)]
    options = dict(rounds=7, learning_rate=0.4, patience=2, depth=3, feature_fraction=0.7, seed=5)
    forest.boost(frame(spark, x, ys, parts), cuts, range(3), goals, len(x), accuracy=10_000, **options)
    sizes = set()
    for g, goal in enumerate(goals):
        trees, best = plain_boost(x, np.where(parts[g] < 0, 0, ys[g]), parts[g], cuts, alphas[g], bases[g],
                                  7, 0.4, 2, 3, 0.7, 5)
        assert len(goal.trees) == len(trees)
        for mine, theirs in zip(goal.trees, trees):
            assert [(n.feature, n.threshold, n.left, n.right) for n in mine] == [
                (n.feature, n.threshold, n.left, n.right) for n in theirs]
            assert [n.value for n in mine] == pytest.approx([n.value for n in theirs])
        assert goal.best_error == pytest.approx(best)
        if goal.best_size:
            assert goal.mae_validation == pytest.approx(best)
        sizes.add(len(trees))
    assert len(sizes) > 1


def test_summaries_keep_ranks():
    rng = np.random.RandomState(1)
    whole = rng.exponential(size=200_000)
    values, weights = np.zeros(0), np.zeros(0)
    for part in np.array_split(whole, 40):
        v, w = forest._summary(part, np.ones(len(part)), 500)
        values, weights = np.concatenate([values, v]), np.concatenate([weights, w])
    assert weights.sum() == pytest.approx(200_000)
    v, w = forest._summary(values, weights, 500)
    for alpha in (0.1, 0.5, 0.9):
        got = forest._quantile(v, w, alpha)
        assert abs((whole <= got).mean() - alpha) < 2 / 500
    few = np.array([3.0, 1.0, 2.0])
    assert forest._quantile(*forest._summary(few, np.ones(3), 10), 0.5) == 2.0


def test_split_weeks_equals_the_split_of_each_value(spark, rows):
    data_ = [(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d} 0{d % 9}:00", None if d % 5 == 0 else 1.0,
              1.0 if d < 30 or d > 120 else None, 1.0 if d < 9 else None) for d in range(160)]
    df = rows("d timestamp_ntz, a double, b double, c double", data_)
    a, b, c = split_weeks(df, ["a", "b", "c"], ts="d")
    assert c is None
    for value, parts in (("a", a), ("b", b)):
        own = nested_holdout(df.where(F.col(value).isNotNull()), ts="d")
        assert {r["split"]: r["rows"] for r in split_counts(own).collect()} == parts.rows
        named = F.when(parts.number == 0, "fit").when(parts.number == 1, "val").when(parts.number == 2, "test")
        got = df.select("d", value, named.alias("split"))
        assert sorted(map(str, got.where(F.col(value).isNotNull()).collect())) == sorted(
            map(str, own.select("d", value, "split").collect()))
        assert got.where(F.col(value).isNull() & F.col("split").isNotNull()).isEmpty()


def test_all_targets_in_one_run(spark, rows):
    """Targets with gaps of their own, one with too few weeks, one too small, one without values."""
    rng = random.Random(2)
    data_ = []
    for i in range(1200):
        air = rng.uniform(0, 30)
        level = air / 4 + rng.gauss(0, 1)
        data_.append((f"2024-{1 + i // 240:02d}-{1 + i // 12 % 20:02d} {2 * (i % 12):02d}:00", i, air, rng.uniform(30, 90),
                      1000.0 + i % 9, float(i % 24), air, level, None if i % 3 == 0 else level / 2,
                      level if i < 120 else None, level if i < 20 else None, None))
    df = rows(f"{N.DATE} timestamp_ntz, id int, `{N.AIR_TEMP}` double, `{N.HUMIDITY}` double, `{N.PRESSURE}` double, "
              "hour double, AT_TLAG_15 double, DO double, DO_delta_1h double, DO_1h double, DO_3h double, DO_6h double",
              data_)
    options = dict(tiebreak=["id"], rounds=4, learning_rate=0.3, patience=3)
    models, failures = train_targets(df, **options)
    assert {m.target for m in models} == {"DO", "DO_delta_1h", "DO_1h"}
    assert set(failures) == {"DO_3h", "DO_6h"}
    by_name = {m.target: m for m in models}
    assert sum(by_name["DO_delta_1h"].rows.values()) == 800
    alone = train_quantile(df, "DO", require_features=True, **options)
    both = by_name["DO"]
    assert (both.base, both.medians, both.rows) == (alone.base, alone.medians, alone.rows)
    assert both.trees == alone.trees and both.mae == pytest.approx(alone.mae)
    assert both.mae_validation == pytest.approx(alone.mae_validation)


def test_executors_add_up_and_the_driver_gets_little(spark, monkeypatch):
    """Only best splits and leaf values come to the driver, however many rows and blocks there are."""
    x, ys, parts, cuts = data(3000)
    monkeypatch.setattr(forest, "ROWS_PER_TASK", 300)
    monkeypatch.setattr(forest, "ROUNDS_PER_TABLE", 2)
    sizes, collect = [], RDD.collect

    def measured(rdd):
        found = collect(rdd)
        sizes.append(len(pickle.dumps(found)))
        return found

    def trained(**settings):
        for name, value in settings.items():
            monkeypatch.setattr(forest, name, value)
        alphas = [0.5, 0.9, 0.1]
        goals = [Goal(a, float(np.quantile(y[p == 0], a, method="lower"))) for y, p, a in zip(ys, parts, alphas)]
        sizes.clear()
        forest.boost(frame(spark, x, ys, parts), cuts, range(3), goals, len(x), accuracy=10_000, rounds=4,
                     learning_rate=0.4, patience=2, depth=3, feature_fraction=0.7, seed=5)
        return [(g.trees, round(g.mae, 9), round(g.best_error, 9)) for g in goals], max(sizes)

    monkeypatch.setattr(RDD, "collect", measured)
    wanted, all_parts = trained()
    assert all_parts > 30_000
    for settings in (dict(DRIVER_BYTES=0), dict(BYTES_PER_SUM=1), dict(ONE_PASS_ROWS=0, PROBES=8)):
        got, most = trained(**settings)
        assert got == wanted
        assert most < 8_000


def test_ranges_hold_the_quantile_of_ties_and_uneven_blocks(spark, monkeypatch):
    """With few probes, and with most rows of one value, the value of a leaf is the plain quantile."""
    monkeypatch.setattr(forest, "ONE_PASS_ROWS", 0)
    monkeypatch.setattr(forest, "PROBES", 4)
    rng = np.random.RandomState(3)
    blocks = []
    for n in (1, 7, 400, 3000):
        y = np.where(rng.uniform(size=n) < 0.6, 0.0, rng.normal(size=n))[None]
        blocks.append(forest.Block(f"b{n}", np.zeros((1, n), np.uint8), y, np.zeros((1, n), np.int8), np.zeros((1, n))))
    whole = np.sort(np.concatenate([b.y[0] for b in blocks]))
    rdd = spark.sparkContext.parallelize([pickle.dumps(b) for b in blocks], 4)
    for alpha in (0.001, 0.1, 0.3, 0.5, 0.9, 0.9999):
        for on_driver in (False, True):
            tree = forest._valued(rdd, [], [Goal(alpha, 0.0)], {0: [Node(-1, 0.0, -1, -1, 0.0)]}, 1.0, 10_000, len(whole),
                                  on_driver)[0]
            assert tree[0].value == whole[math.ceil(alpha * len(whole) - 1e-9) - 1]
