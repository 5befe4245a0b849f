"""Splits, training, scoring, the registry and pairing."""

import math
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline import names as N
from gaugeline.operators.boosting import (
    quantile_alpha, train_quantile, train_targets, train_tiers,
)
from gaugeline.operators.holdout import (
    check_split_sizes, holdout, nested_holdout, split_counts, week_key,
)
from gaugeline.operators.neighbourhood import pair_predictions
from gaugeline.operators.scoring import metrics_report, score, score_tiers
from gaugeline.sources.registry import delete_model, list_models, load_model, save_model

START = datetime(2024, 1, 1)


def dated(spark, days):
    return spark.createDataFrame(
        [(START + timedelta(days=d), i) for i, d in enumerate(days)], "ts timestamp_ntz, id int")


@pytest.mark.parametrize("weeks", [3, 5, 10, 11])
def test_whole_weeks_are_held_out(spark, weeks):
    df = dated(spark, range(weeks * 7))
    split = nested_holdout(df, ts="ts", tiebreak=["id"])
    test = max(1, math.ceil(weeks * 0.3))
    left = weeks - test
    got = {r["split"]: r["rows"] for r in split_counts(split).collect()}
    if left >= 3:
        val = max(1, math.ceil(left * 0.2)) * 7
    else:
        val = left * 7 - int(left * 7 * 0.8)
    assert got == {"test": test * 7, "val": val, "fit": left * 7 - val}
    order = [r["split"] for r in split.orderBy("ts").collect()]
    assert order == sorted(order, key=["fit", "val", "test"].index)


def test_few_weeks_split_by_rows(spark):
    df = dated(spark, [0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8])
    got = holdout(df, ts="ts", tiebreak=["id"]).orderBy("id").collect()
    assert [r["split"] for r in got] == ["train"] * 7 + ["test"] * 4
    assert holdout(df.limit(0), ts="ts").count() == 0


def test_iso_weeks(spark):
    df = dated(spark, [-1096 + 1, 0, 364]).select("id", week_key(F.col("ts")).alias("w"))
    assert [r["w"] for r in df.orderBy("id").collect()] == ["2020-W53", "2024-W1", "2025-W1"]


def test_split_sizes():
    check_split_sizes({"fit": 15, "val": 5, "test": 10})
    for counts in ({"fit": 14, "val": 5, "test": 10}, {"fit": 30, "val": 4, "test": 10},
                   {"fit": 30, "val": 5, "test": 9}, {}):
        with pytest.raises(ValueError):
            check_split_sizes(counts)
    with pytest.raises(ValueError):
        check_split_sizes({"fit": 15, "val": 5, "test": 9}, least_rows=30)


def test_tiers():
    assert [quantile_alpha(t) for t in ("low", " High ", "mid", "other")] == [
        ("low", 0.1), ("high", 0.9), ("mid", 0.5), ("mid", 0.5)]


def test_trees_split_where_plain_trees_do(spark, readings):
    """One round, one level: the split with the largest gain among all cuts, by hand."""
    model = train_quantile(readings, "DO", "high", tiebreak=["id"], rounds=1, learning_rate=1.0, depth=1,
                           feature_fraction=1.0)
    rows = nested_holdout(readings, ts=N.DATE, tiebreak=["id"]).where("split = 'fit'").toPandas()
    slope = (rows["DO"] > model.base) - 0.1
    best = (0.0, None, None)
    for f, name in enumerate(model.features):
        x = rows[name] if name in rows else getattr(rows[N.DATE].dt, name)
        x = x.astype(float).fillna(model.medians[name])
        for cut in sorted(set(x))[:-1]:
            left = slope[x <= cut]
            right = slope[x > cut]
            if min(len(left), len(right)) >= 20:
                gain = left.sum() ** 2 / len(left) + right.sum() ** 2 / len(right)
                if gain > best[0]:
                    best = (gain, f, cut)
    root = model.trees[0][0]
    assert root.feature == best[1]
    spread = rows[model.features[best[1]]].astype(float)
    # Cuts are quantiles, at most 255, so the best of all values may lie between two of them.
    assert abs((spread <= root.threshold).mean() - (spread <= best[2]).mean()) < 2 / 255


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(4)
    data = []
    for i in range(1500):
        air = rng.uniform(0, 30)
        level = air / 3 + (i // 24 % 5) + rng.gauss(0, 1)
        data.append((START + timedelta(hours=i), i, None if i % 40 == 1 else air, rng.uniform(30, 90),
                     1000.0 + i % 7, i % 24, air, level, level / 2, None))
    return spark.createDataFrame(
        data, f"{N.DATE} timestamp_ntz, id int, `{N.AIR_TEMP}` double, `{N.HUMIDITY}` double, "
        f"`{N.PRESSURE}` double, hour int, AT_TLAG_15 double, DO double, DO_delta_1h double, "
        "DO_6h double")


OPTIONS = dict(tiebreak=["id"], rounds=6, learning_rate=0.4, patience=3)


@pytest.fixture(scope="module")
def tiers(readings):
    return train_tiers(readings, "DO", **OPTIONS)


def test_training_leaves_no_tables_behind(spark, readings):
    import os

    from gaugeline.session import shared_folder

    def tables():
        return {d for d in os.listdir(shared_folder(spark).removeprefix("file:")) if d.startswith("gaugeline-")}

    before = tables()
    train_quantile(readings, "DO", "mid", **(OPTIONS | dict(rounds=9)))
    # What is left are the rows before the split and the columns of the medians.
    assert len(tables() - before) <= 3


def pinball(scored, column, alpha):
    gap = F.col("DO") - F.col(column)
    return scored.agg(F.avg(F.greatest(alpha * gap, (alpha - 1) * gap))).first()[0]


def test_quantiles(readings, tiers):
    scored = readings
    for model in tiers.values():
        scored = score(scored, model)
    assert scored.count() == readings.count()
    for label, alpha in N.QUANTILE_TIERS.items():
        model, column = tiers[label], f"pred_DO_quantile_{label}"
        base = readings.withColumn("base", F.lit(model.base))
        assert pinball(scored, column, alpha) < pinball(base, "base", alpha)
        share = scored.agg(F.avg((F.col("DO") <= F.col(column)).cast("int"))).first()[0]
        assert share == pytest.approx(alpha, abs=0.12)
        assert 1 <= len(model.trees) <= 6 and sum(model.rows.values()) == 1500
        assert model.mae > 0 and model.mae_validation > 0
        assert model.medians["hour"] == 11.5 or model.medians["hour"] == pytest.approx(11.5, abs=1)
    mean = scored.agg(*[F.avg(f"pred_DO_quantile_{t}") for t in ("low", "mid", "high")]).first()
    assert mean[0] < mean[1] < mean[2]
    repeat = train_quantile(readings, "DO", "mid", **OPTIONS)
    assert repeat.trees == tiers["mid"].trees


def test_tiers_of_one_structure(spark, readings):
    """One training: the same splits, an order on every row, and the share of rows each tier asks for."""
    models = train_tiers(readings, "DO", shared=True, tiebreak=["id"], rounds=40, learning_rate=0.1, patience=40)
    shape = lambda m, n: [[(x.feature, x.threshold, x.left, x.right) for x in t] for t in m.trees[:n]]
    n = min(len(m.trees) for m in models.values())
    assert n > 5 and shape(models["low"], n) == shape(models["mid"], n) == shape(models["high"], n)
    scored = score_tiers(readings, models)
    low, mid, high = (f"pred_DO_quantile_{t}" for t in ("low", "mid", "high"))
    assert scored.count() == 1500 and scored.where(f"NOT (`{low}` <= `{mid}` AND `{mid}` <= `{high}`)").isEmpty()
    share = scored.agg(*[F.avg((F.col("DO") <= F.col(c)).cast("int")) for c in (low, mid, high)]).first()
    assert list(share) == pytest.approx([0.1, 0.5, 0.9], abs=0.1)
    for model, column in zip((models["low"], models["high"]), (low, high)):
        base = scored.withColumn("base", F.lit(model.base))
        assert pinball(base, column, model.alpha) < 0.8 * pinball(base, "base", model.alpha)
    # Crossing predictions of any models are put in order.
    crossing = {"low": models["low"], "high": replace(models["high"], base=models["low"].base - 100)}
    assert score_tiers(readings, crossing).where(f"`{low}` > `{high}`").isEmpty()
    with pytest.raises(ValueError):
        score_tiers(readings, {"a": models["low"], "b": models["low"]})


def test_training_by_default_stops_and_beats_the_constant(spark, readings):
    """300 rounds at most, 50 without a gain."""
    model = train_quantile(readings, "DO", "low", tiebreak=["id"])
    scored = score(readings, model).withColumn("base", F.lit(model.base))
    assert pinball(scored, "pred_DO_quantile_low", 0.1) < 0.8 * pinball(scored, "base", 0.1)
    assert 10 < len(model.trees) <= 300
    assert all(sum(n.feature < 0 for n in t) <= N.TREE_LEAVES for t in model.trees)


def test_missing_features_take_the_median(spark, readings, tiers):
    model = tiers["mid"]
    row = readings.limit(1).withColumn(N.AIR_TEMP, F.lit("M"))
    filled = readings.limit(1).withColumn(N.AIR_TEMP, F.lit(model.medians[N.AIR_TEMP]))
    column = "pred_DO_quantile_mid"
    assert score(row, model).first()[column] == score(filled, model).first()[column]
    assert score(row, model).first()[N.AIR_TEMP] == "M"
    assert "pred_DO_weather_only" in score(row, model, weather_only=True).columns
    with pytest.raises(ValueError, match="AT_TLAG_15"):
        score(readings.drop("AT_TLAG_15"), model)
    with pytest.raises(ValueError, match="DATE"):
        score(readings.drop(N.DATE), model)


def test_both_ways_of_scoring_agree(spark, readings, tiers):
    """To the last digit; the expression needs no Python worker."""
    from gaugeline.operators.boosting import Node

    column = "pred_DO_quantile_low"
    low = tiers["low"]
    odd = [Node(0, float("inf"), 1, 2, 0.0), Node(-1, 0.0, -1, -1, 1e-300), Node(-1, 0.0, -1, -1, -1e300)]
    for model in (low, replace(low, trees=[]), replace(low, trees=[*low.trees, odd], base=-0.1)):
        native, arrow = score(readings, model, native=True), score(readings, model, native=False)
        got = [sorted((r["id"], r[column]) for r in df.collect()) for df in (native, arrow)]
        assert got[0] == got[1]
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (native, arrow)]
        assert "ArrowEvalPython" not in plans[0] and ("ArrowEvalPython" in plans[1])


def test_registry(spark, readings, tiers, tmp_path):
    folder = str(tmp_path / "models")
    assert list_models(spark, folder).count() == 0
    name = save_model(spark, tiers["high"], folder)
    assert name == "model_DO_quantile_high"
    save_model(spark, tiers["low"], folder)
    back = load_model(spark, folder, name)
    assert back == tiers["high"]
    listed = list_models(spark, folder).collect()
    assert [r["name"] for r in listed] == ["model_DO_quantile_high", "model_DO_quantile_low"]
    assert listed[0]["feature_count"] == 9 and listed[0]["alpha"] == 0.9
    delete_model(spark, folder, name)
    assert [r["name"] for r in list_models(spark, folder).collect()] == ["model_DO_quantile_low"]
    with pytest.raises(ValueError):
        load_model(spark, folder, name)
    with pytest.raises(ValueError):
        delete_model(spark, folder, name)


def test_registry_does_not_ask_the_clock(spark, tiers, tmp_path):
    """Rows of one moment, and of a writer whose clock is late, are told apart by their versions."""
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "models")
    with ThreadPoolExecutor(4) as writers:
        list(writers.map(lambda t: save_model(spark, tiers[t], folder, "shared"), ["low", "mid", "high", "low"]))
    # A local disk may let two writers have one version; all readers still see the same one row.
    whole = spark.read.option("recursiveFileLookup", True)
    versions = [r["version"] for r in whole.parquet(folder).collect()]
    assert len(versions) == 4 and len(set(versions)) > 1 and set(versions) <= {1, 2, 3, 4}
    assert list_models(spark, folder).count() == 1
    seen = [load_model(spark, folder, "shared").label for _ in range(2)]
    assert seen[0] == seen[1]
    save_model(spark, tiers["high"], folder, "shared")
    assert load_model(spark, folder, "shared") == tiers["high"]
    delete_model(spark, folder, "shared")
    same = str(tmp_path / "same")
    whole.parquet(folder).withColumn("saved_at", F.lit("2000-01-01").cast("timestamp")).write.parquet(same)
    assert list_models(spark, same).count() == 0
    late = whole.parquet(folder).withColumn(
        "saved_at", F.timestamp_seconds(F.lit(2_000_000_000) - F.col("version")))
    late.write.parquet(str(tmp_path / "late"))
    assert list_models(spark, str(tmp_path / "late")).count() == 0
    save_model(spark, tiers["mid"], folder, "shared")
    assert load_model(spark, folder, "shared") == tiers["mid"]


def test_targets_that_fail_are_reported(spark, readings):
    models, failures = train_targets(readings, ["DO_delta_1h", "DO_6h", "gone"], **OPTIONS)
    assert [m.target for m in models] == ["DO_delta_1h"] and set(failures) == {"DO_6h"}
    # Rows with a missing feature are left out here.
    assert sum(models[0].rows.values()) == 1500 - 38
    report = {r["target"]: r for r in metrics_report(spark, models, failures).collect()}
    assert report["DO_delta_1h"]["mae_test"] > 0 and report["DO_6h"]["failure"]
    with pytest.raises(ValueError):
        train_targets(readings, ["gone"])
    with pytest.raises(ValueError):
        train_quantile(readings, "hour")


def test_pairing(spark):
    left = spark.createDataFrame([(1, "a", 5.0), (2, "a", 6.0)], "t int, k string, change double")
    right = left.select("t", "k", (F.col("change") * 2).alias("level"))
    got = pair_predictions(left, right, ["level"], ts="t", keys=["k"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 5.0, 10.0), (2, "a", 6.0, 12.0)]
    for odd in (right.where("t = 1"), right.union(right.where("t = 2"))):
        with pytest.raises(Exception, match="do not pair up"):
            pair_predictions(left, odd, ["level"], ts="t", keys=["k"]).collect()


def test_pairing_of_rows_that_share_a_time(spark):
    left = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 7.0)], "t int, i int, change double")
    right = left.select("t", "i", (F.col("change") * 2).alias("level"))
    got = pair_predictions(left, right, ["level"], ts="t", tiebreak=["i"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 5.0, 10.0), (1, 2, 6.0, 12.0), (2, 1, 7.0, 14.0)]
    for odd in (right.where("i = 1"), right.union(right.where("t = 2"))):
        with pytest.raises(Exception, match="do not pair up"):
            pair_predictions(left, odd, ["level"], ts="t", tiebreak=["i"]).collect()
