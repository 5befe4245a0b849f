"""Coverage, day blocks, daily fits, weather reports and the transition table."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline import names as N
from gaugeline.functions.columns import reorder
from gaugeline.operators.coverage import day_blocks, longest_hour_run
from gaugeline.operators.fit import daily_fit
from gaugeline.plans.lake import lake_features, lake_lag_table
from gaugeline.plans.reports import coverage_report, daily_fit_report, transition_table
from gaugeline.plans.weather import (
    add_weather_lags, normalise_weather, prepare_parsed, yearly_analytics,
)

# Published day blocks as (start, days, weeks, rest, gap to the next block).
BLOCKS = [
    (date(2024, 7, 10), 3, 0, 3, 1), (date(2024, 7, 14), 46, 6, 4, 335),
    (date(2025, 7, 30), 7, 1, 0, 3), (date(2025, 8, 9), 1, 0, 1, 1),
    (date(2025, 8, 11), 38, 5, 3, 6), (date(2025, 9, 24), 6, 0, 6, 1),
    (date(2025, 10, 1), 4, 0, 4, 1), (date(2025, 10, 6), 25, 3, 4, None),
]


def test_published_day_blocks(spark):
    days = [(b[0] + timedelta(days=i),) for b in BLOCKS for i in range(b[1])]
    got = day_blocks(spark.createDataFrame(days, "calendar_date date")).orderBy("block_id")
    assert [tuple(r) for r in got.collect()] == [
        (n, start, start + timedelta(days=size - 1), size, weeks, rest, gap)
        for n, (start, size, weeks, rest, gap) in enumerate(BLOCKS, 1)
    ]


@pytest.mark.parametrize("hours, best", [({8, 9, 10, 14, 15}, 3), (set(), 0), ({0}, 1),
                                         (set(range(24)), 24), ({0, 22, 23}, 2)])
def test_longest_hour_run(spark, hours, best):
    mask = F.lit(sum(1 << h for h in hours))
    assert spark.range(1).select(longest_hour_run(mask).alias("n")).first()["n"] == best


def test_coverage_of_mixed_date_texts(spark):
    texts = ["2024-07-12 08:10:00", "7/12/24 8:20", "2024-07-13", "bad", None]
    out = coverage_report(spark.createDataFrame([(t,) for t in texts], "DATE string"))
    day = out["daily_time_coverage"].orderBy("calendar_date").first()
    assert tuple(day)[:4] == (
        date(2024, 7, 12), 2, datetime(2024, 7, 12, 8, 10), datetime(2024, 7, 12, 8, 20))
    assert day["distinct_hours_with_data"] == 1 and day["hours_missing_in_day"] == 23
    assert day["missing_hours_list"] == ",".join(str(h) for h in range(24) if h != 8)
    assert out["dropped_rows"].first()["dropped"] == 2
    assert out["consecutive_day_blocks"].count() == 1


def test_daily_fit_semantics(rows):
    df = rows("DATE timestamp_ntz, DO double", [
        ("2025-10-09 13:30", 2.0), ("2025-10-09 14:00", 2.32),
        ("2025-10-10 01:00", 4.0), ("2025-10-10 02:00", 4.0), ("2025-10-10 03:00", 4.0),
        ("2025-10-11 01:00", 1.0), ("2025-10-11 02:00", None), ("2025-10-11 03:00", float("inf")),
        ("2025-10-12 05:00", None),
    ])
    got = {r["date"]: r for r in daily_fit(df, ts="DATE", value="DO").collect()}
    two = got["2025-10-09"]
    assert (two["n_points"], two["time_start_h"], two["time_end_h"]) == (2, 13.5, 14.0)
    assert two["slope_DO_per_hour"] == pytest.approx(0.64) and two["r_squared"] == pytest.approx(1)
    assert two["intercept"] == pytest.approx(-6.64)
    flat = got["2025-10-10"]
    assert (flat["slope_DO_per_hour"], flat["r_squared"]) == (0.0, 0.0)
    one = got["2025-10-11"]
    assert (one["n_points"], one["slope_DO_per_hour"], one["time_start_h"]) == (1, None, 1.0)
    none = got["2025-10-12"]
    assert (none["n_points"], none["time_start_h"]) == (0, None)
    report = {r["date"]: r for r in daily_fit_report(df).collect()}
    total = report[N.SUMMARY_LABEL]
    assert total["n_points"] == 6 and total["slope_DO_per_hour"] == pytest.approx(0.32)
    assert total["intercept"] is None


RAW = [
    ("2001-04-30 23:30", "9", "50", "1013.2"), ("2001-05-01 00:00", "10", "50", ""),
    ("2001-05-01 03:10", "11", "NaN", "1013.2"), ("2001-05-01 03:40", None, "60", "1000"),
    ("2001-09-30 23:30", "12", "60", "1001"), ("2001-07-01 10:00", "13", "60", "M"),
    ("2001-07-01 11:00", "14", "60", "m"), ("never", "15", "60", "1002"),
    ("2001-10-01 00:10", "16", "60", "1002"),
]


def test_weather_rules(spark):
    df = spark.createDataFrame([(*r, "x") for r in RAW],
                               "valid string, tmpc string, relh string, mslp string, extra string")
    got = normalise_weather(df)
    assert got.columns == [N.DATE, N.AIR_TEMP, N.HUMIDITY, N.PRESSURE, N.HOUR]
    assert sorted((r[N.DATE], r[N.HOUR], r[N.AIR_TEMP] or "") for r in got.collect()) == [
        ("2001-05-01 00:00:00", 0.0, "10"), ("2001-05-01 04:00:00", 4.0, ""),
        ("2001-05-01 04:00:00", 4.0, "11"), ("2001-10-01 00:00:00", 0.0, "12"),
    ]
    typed = prepare_parsed(got)
    assert typed.where(typed[f"`{N.HUMIDITY}`"].isNull()).count() == 1


PARSED = [
    ("1999-01-05 00:00:00", 1.0, 10.0, 1000.0, 0.0), ("1999-07-01 00:00:00", 20.0, 40.0, 1000.0, 0.0),
    ("2000-02-29 12:00:00", 5.0, 30.0, 1001.0, 12.0), ("2000-07-01 00:00:00", 20.0, 60.0, 1002.0, 0.0),
    ("2001-03-01 00:00:00", 99.0, 99.0, 1003.0, 0.0),
    ("2002-07-01 00:00:00", 8.0, None, None, 0.0), ("2002-07-01 00:00:00", 9.0, 20.0, 1004.0, 0.0),
]
PARSED_SCHEMA = (f"`{N.DATE}` string, `{N.AIR_TEMP}` double, `{N.HUMIDITY}` double, "
                 f"`{N.PRESSURE}` double, {N.HOUR} double")


def test_yearly_reports(spark):
    out = yearly_analytics(spark.createDataFrame(PARSED, PARSED_SCHEMA))
    # 1999 and 2000 tie on temperature; the earlier year wins, with all its rows.
    hot = out[N.REPORT_HOTTEST]
    assert sorted(r[N.DATE] for r in hot.collect()) == ["1999-01-05 00:00:00", "1999-07-01 00:00:00"]
    assert sorted(r[N.DATE] for r in out[N.REPORT_HUMID].collect()) == [
        "2000-02-29 12:00:00", "2000-07-01 00:00:00"]
    slots = {r[N.DATE]: tuple(r)[1:] for r in out[N.REPORT_AVERAGE].collect()}
    assert slots["2000-02-29 12:00:00"] == (5.0, 30.0, 1001.0, 12.0)
    # A year with two rows in a slot weighs twice; missing values are skipped.
    assert slots["2000-07-01 00:00:00"] == (14.25, 40.0, 1002.0, 0.0)
    assert len(slots) == 4


def test_no_summer_raises(spark):
    df = spark.createDataFrame(PARSED[:1], PARSED_SCHEMA)
    with pytest.raises(Exception, match="No values of Air temp C"):
        yearly_analytics(df)[N.REPORT_HOTTEST].collect()
    with pytest.raises(ValueError, match="Missing columns"):
        yearly_analytics(df.drop(N.PRESSURE))


def test_weather_lags_can_be_run_twice(spark):
    data = [(f"2001-06-01 {h:02d}:00:00", None if h == 4 else float(h), 5.0, 6.0, float(h))
            for h in range(9)]
    once = add_weather_lags(spark.createDataFrame(data, PARSED_SCHEMA))
    assert once.columns == [N.DATE, N.AIR_TEMP, N.HUMIDITY, N.PRESSURE, N.HOUR,
                            *N.WEATHER_LAG_HOURS]
    got = sorted(tuple(r)[4:] for r in once.collect())
    # Hour 5 looks up the missing reading of hour 4 and then takes the lag before it.
    assert [g[1] for g in got] == [0, 0, 1, 2, 3, 3, 5, 6, 7]
    assert [g[2] for g in got] == [0, 0, 0, 0, 1, 2, 3, 3, 5]
    assert [g[3] for g in got] == [0, 0, 0, 0, 0, 0, 0, 1, 2]
    assert sorted(add_weather_lags(once).collect()) == sorted(once.collect())


def lake_rows():
    start = datetime(2024, 7, 10)
    return [
        ((start + timedelta(minutes=30 * i)).strftime("%m/%d/%y %H:%M"),
         "0" if i == 3 else str(i / 10), str(20 + i), "1" if i % 7 < 3 else "0")
        for i in range(40)
    ]


LAKE_SCHEMA = f"`{N.DATE}` string, DO string, `{N.AIR_TEMP}` string, `{N.FLAG}` string"


def test_lake_features_drop_before_they_look(spark):
    df = spark.createDataFrame(lake_rows(), LAKE_SCHEMA)
    out = lake_features(df, (1,))
    assert out.columns == [N.DATE, "DO", N.AIR_TEMP, N.FLAG, "hour", *[
        f"{p}{s}" for p in ("DO_TLAG_", "AT_TLAG_", "Aerator_TLAG_") for s in (15, 30, 60)],
        "DO_delta_1h", "DO_1h"]
    got = {round(r["DO"] * 10): r for r in out.collect()}
    # The first reading is a zero too, so lags of 6 hours start at row 13.
    assert min(got) == 13 and max(got) == 39 and len(got) == 27
    assert got[13]["DO_TLAG_60"] == 0.1 and got[13]["AT_TLAG_15"] == 31.0
    assert got[15]["DO_TLAG_60"] == 0.2, "row 3 was a zero reading, so row 2 is the lag"
    assert got[20]["Aerator_TLAG_15"] == 30.0 * sum(i % 7 < 3 for i in (19, 20))
    assert (got[30]["DO_1h"], got[30]["DO_delta_1h"]) == (3.2, 0.2)
    assert got[39]["DO_1h"] is None
    lags_only = lake_lag_table(df)
    assert lags_only.columns == out.columns[:-2] and lags_only.count() == 27


def test_lake_features_without_level_or_air(spark):
    df = spark.createDataFrame(lake_rows(), LAKE_SCHEMA)
    with pytest.raises(ValueError):
        lake_features(df.select(N.DATE, N.AIR_TEMP))
    bare = lake_features(df.drop(N.AIR_TEMP), (1,))
    assert bare.count() == 38 and "DO_TLAG_15" not in bare.columns
    assert lake_lag_table(df.select(N.DATE, N.AIR_TEMP)).count() == 40


def test_transition_table(spark):
    start = datetime(2024, 7, 10)
    readings = [(start + timedelta(hours=h), h, 1.0 if 50 <= h < 52 else 0.0, 10.0 * h)
                for h in range(100)]
    df = spark.createDataFrame(
        readings, f"{N.DATE} timestamp_ntz, id int, `{N.FLAG}` double, Aerator_TLAG_15 double")
    features = reorder(df.select(
        N.DATE, F.col("id").cast("double").alias("DO"), F.lit(1).alias("DO_delta_1h"),
        F.lit(2).alias("DO_1h"), F.lit(3).alias("DO_12h"), F.lit(9).alias(N.FLAG)), [N.DATE, "DO"])
    out = transition_table(features.union(features.where("DO = 50")), df, tiebreak=["id"])
    assert out.columns == [N.DATE, "DO", N.FLAG, "Aerator_TLAG_15", "DO_1h"]
    got = sorted(r["DO"] for r in out.collect())
    assert got == sorted([*map(float, range(38, 65)), 50.0])
    assert {r[N.FLAG] for r in out.where("DO IN (50, 51)").collect()} == {1.0}
