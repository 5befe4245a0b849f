"""Reading numbers, dates and hours; finding columns; row filters."""

from datetime import datetime

import pytest

from gaugeline import names as N
from gaugeline.functions import columns as C
from gaugeline.functions import values as V
from gaugeline.operators import clean


@pytest.mark.parametrize("text, value", [
    ("1", 1.0), (" 2 ", 2.0), ("-.5", -0.5), ("1.", 1.0), ("+1e3", 1000.0), ("inf", float("inf")),
    ("-Infinity", float("-inf")), ("1D", None), ("1f", None), ("1,000", None), ("M", None),
    ("0x1", None), ("NaN", None), ("", None), (None, None),
])
def test_number(spark, text, value):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(V.number(df, "a").alias("n")).first()["n"] == value


def test_number_of_typed_columns(spark):
    df = spark.createDataFrame([(float("nan"), 3), (2.5, None)], "`x (%)` double, n int")
    got = V.with_numbers(df, ["x (%)", "n"])
    assert [tuple(r) for r in got.collect()] == [(None, 3.0), (2.5, None)]
    assert got.dtypes == [("x (%)", "double"), ("n", "double")]


@pytest.mark.parametrize("text, time", [
    ("2024-07-10 12:40:00", datetime(2024, 7, 10, 12, 40)),
    ("2024-07-10 12:40", datetime(2024, 7, 10, 12, 40)),
    ("2024-07-10T12:40:01.5", datetime(2024, 7, 10, 12, 40, 1, 500000)),
    ("2024-07-10", datetime(2024, 7, 10)),
    ("7/16/24 9:20", datetime(2024, 7, 16, 9, 20)),
    (" 7/16/2024 09:20 ", datetime(2024, 7, 16, 9, 20)),
    ("12/1/24", datetime(2024, 12, 1)),
    ("13/40/24 9:20", None), ("T12:00", None), ("soon", None), ("", None), (None, None),
])
def test_timestamp(spark, text, time):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(V.timestamp(df, "a").alias("t")).first()["t"] == time


@pytest.mark.parametrize("text, up", [
    ("2024-01-01 05:00:00", "2024-01-01 05:00:00"), ("2024-01-01 05:30:00", "2024-01-01 06:00:00"),
    ("2024-12-31 23:00:00.000001", "2025-01-01 00:00:00"),
])
def test_ceil_hour(spark, text, up):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(V.date_text(V.ceil_hour(V.timestamp(df, "a"))).alias("t")).first()["t"] == up


def test_hour_is_kept_or_filled(rows):
    df = rows("DATE timestamp_ntz, hour string",
              [("2024-01-01 05:10", "7"), ("2024-01-01 05:10", " "), ("2024-01-01 05:10", None)])
    assert [r["hour"] for r in clean.fill_hour(df, "DATE").collect()] == ["7", "5", "5"]
    added = clean.fill_hour(df.drop("hour"), "DATE")
    assert added.dtypes[-1] == ("hour", "int") and added.first()["hour"] == 5


def test_zero_levels_go_and_missing_ones_stay(spark):
    df = spark.createDataFrame([("0",), ("0.0",), (" 0 ",), (None,), ("x",), ("0.1",)], "DO string")
    assert [r[0] for r in clean.drop_zero_level(df, "DO").collect()] == [None, "x", "0.1"]
    assert clean.drop_zero_level(df, None).count() == 6


def test_first_per_takes_the_first_by_tiebreak(spark):
    df = spark.createDataFrame([(1, 2, "b", None), (1, 1, "c", 5), (2, 9, "a", 1)],
                               "k int, id int, v string, w int")
    got = clean.first_per(df, ["k"], ["v", "w"], ["id"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "c", 5), (2, "a", 1)]


def test_column_search():
    assert C.date_column(["x", "DATE"], None) == "DATE"
    assert C.date_column(["x", "DATE"], "x") == "x"
    assert C.date_column(["x", "y"], "gone") == "x"
    assert C.level_column(["a", "Window", "DO"]) == "DO"
    assert C.level_column(["a", "Window"]) == "Window"
    assert C.level_column(["a"]) is None
    assert C.flag_column(["a", "AERATED x", "aerator"]) == "AERATED x"


def test_targets_and_features():
    columns = ["DO", "DO_12h", "DO_6h", "DO_delta_6h", "DO_delta_12h", "DO_1hr"]
    assert C.targets(columns) == ["DO", "DO_delta_12h", "DO_delta_6h", "DO_12h", "DO_6h"]
    assert C.targets(columns, by_length=True) == [
        "DO", "DO_delta_6h", "DO_delta_12h", "DO_6h", "DO_12h"]
    weather = list(N.WEATHER_FEATURES)
    lags = ["AT_TLAG_15", "AT_TLAG_30", "AT_TLAG_60"]
    assert C.feature_columns(weather + lags)[-3:] == lags
    first = ["AT_TLAG_1hr", "AT_TLAG_3hr", "AT_TLAG_6hrs"]
    assert C.feature_columns(weather + lags + first)[-3:] == first
    assert C.feature_columns(weather + ["AT_TLAG_15"])[-1] == "AT_TLAG_15"
    with pytest.raises(ValueError):
        C.feature_columns(weather)
    assert C.feature_columns(weather, lags_required=False) == weather + list(N.CALENDAR_FEATURES)
    with pytest.raises(ValueError):
        C.feature_columns(weather[1:] + lags)


def test_prediction_names():
    assert C.prediction_column("DO_1h", "mid") == "pred_DO_1h_quantile_mid"
    assert C.prediction_column("DO") == "pred_DO"
    assert C.prediction_column("DO", "mid", True) == "pred_DO_weather_only"


def test_column_order(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "DATE int, DO int, b int, f int, DO_1h int")
    assert C.insert_after(df, ["f"], "DO").columns == ["DATE", "DO", "f", "b", "DO_1h"]
    assert C.insert_after(df.drop("DO"), ["f"], "DO").columns == ["DATE", "f", "b", "DO_1h"]
    assert C.reorder(df, ["b", "gone"], ["f"]).columns == ["b", "f", "DATE", "DO", "DO_1h"]
    assert C.drop_matching(df, r"DO_\d+h").columns == ["DATE", "DO", "b", "f"]
    assert C.drop_matching(df, r"DO_\d+h", keep=["DO_1h"]).columns == df.columns


def test_aliases(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "` Valid` int, TMPC int, x int, relh int, mslp int")
    got = C.select_aliases(df)
    assert got.columns == [N.DATE, N.AIR_TEMP, N.HUMIDITY, N.PRESSURE]
    assert tuple(got.first()) == (1, 2, 4, 5)
    with pytest.raises(ValueError, match="Atmospheric"):
        C.select_aliases(df.drop("mslp"))


def test_unreadable_dates_are_counted(spark):
    df = spark.createDataFrame([("2024-01-01",), ("7/16/24 9:20",), ("?",), (None,)], "DATE string")
    assert tuple(V.count_unreadable_dates(df, "DATE").first()) == (4, 2)
