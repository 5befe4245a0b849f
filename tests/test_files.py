"""Whole runs on files: parse, train, predict."""

from datetime import datetime, timedelta

import pytest

from gaugeline import names as N
from gaugeline.plans import files
from gaugeline.sources.tables import read_table

QUICK = dict(rounds=2, learning_rate=0.5)


def put(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def lake_csv(tmp_path_factory):
    start = datetime(2024, 7, 1)
    head = f"{N.DATE},DO,{N.AIR_TEMP},{N.HUMIDITY},{N.FLAG},{N.PRESSURE}"
    lines = [
        f"{(start + timedelta(hours=i)).strftime('%m/%d/%y %H:%M')},{i % 11 + 0.5},{i % 24 + 5},"
        f"{40 + i % 9},{float(i % 24 < 6)},{1000 + i % 5}"
        for i in range(1200)
    ]
    return put(tmp_path_factory.mktemp("lake") / "lake.csv", [head, *lines])


def test_lake_to_predictions(spark, lake_csv, tmp_path):
    features = files.lake_file(spark, lake_csv)
    assert features == lake_csv[:-4] + "_parsed_DOdeltas.csv"
    table = read_table(spark, features)
    assert table.count() == 1194 and "DO_delta_24h" in table.columns
    plain = files.lake_file(spark, lake_csv, horizons=None)
    assert "DO_delta_24h" not in read_table(spark, plain).columns

    registry = str(tmp_path / "models")
    for target in ("DO_delta_1h", "DO_1h"):
        name, model = files.train_file(spark, features, target, registry, **QUICK)
        assert name == f"model_{target}_quantile_mid" and model.rows["test"] > 0
    out, column = files.predict_file(
        spark, registry, "model_DO_1h_quantile_mid", features, str(tmp_path / "predicted"))
    scored = read_table(spark, out)
    assert scored.count() == 1194 and scored.where(f"{column} IS NULL").count() == 0

    report = files.train_all_file(
        spark, features, str(tmp_path / "weather"), str(tmp_path / "metrics"), ["DO"], **QUICK)
    assert report.first()["target"] == "DO"
    record = spark.read.json(str(tmp_path / "metrics")).first()
    assert record["csv"] == features and record["targets_trained"] == ["DO"]
    assert record["results"][0]["train_rows"] > 0
    assert record["results"][0]["model_path"].endswith("/model_weather_only_DO_mid")


def test_reports_and_transitions(spark, lake_csv, tmp_path):
    paths = files.coverage_files(spark, lake_csv, str(tmp_path / "coverage"))
    assert read_table(spark, paths["daily_time_coverage"]).count() == 50
    block = read_table(spark, paths["consecutive_day_blocks"]).collect()
    assert [r["consecutive_calendar_days"] for r in block] == ["50"]
    fits = read_table(spark, files.daily_fit_file(spark, lake_csv, str(tmp_path / "fits")))
    assert fits.count() == 51 and fits.where(f"date = '{N.SUMMARY_LABEL}'").count() == 1
    plain = files.lake_file(spark, lake_csv, str(tmp_path / "plain"), horizons=None)
    near = read_table(spark, files.transition_file(
        spark, plain, plain, str(tmp_path / "near"), bucket="auto"))
    assert near.columns[:3] == [N.DATE, "DO", N.FLAG]
    # Readings 6 to 11 come too early for the first transition, the last 5 too late.
    assert near.count() == 1194 - 6 - 5


def test_weather_files(spark, tmp_path):
    start = datetime(2001, 5, 30)
    raw = put(tmp_path / "station.csv", ["valid,tmpc,relh,mslp,other"] + [
        f"{start + timedelta(minutes=50 * i)},{i % 30},{i % 90},{'M' if i % 10 == 0 else 1000},x"
        for i in range(300)])
    parsed = files.weather_file(spark, raw)
    assert parsed == raw[:-4] + "_parsed.csv" and read_table(spark, parsed).count() == 270
    reports = files.yearly_files(spark, parsed, str(tmp_path / "yearly"))
    assert sorted(reports) == ["Average_Year", "Largest_Humidity_Summer", "Largest_Temp_Summer"]
    assert read_table(spark, reports["Largest_Temp_Summer"]).count() == 270
    (tmp_path / "in").mkdir()
    lines = [",".join(str(v) for v in r) for r in read_table(spark, parsed).collect()]
    head = ",".join(read_table(spark, parsed).columns)
    put(tmp_path / "in" / "a.csv", [head, *lines])
    put(tmp_path / "in" / "b.csv", [head, *lines[:5]])
    put(tmp_path / "in" / "notes.txt", ["no table"])
    out = files.weather_lag_folder(spark, str(tmp_path / "in"), str(tmp_path / "lagged"), "auto")
    back = spark.read.option("header", True).csv(out)
    assert {r["series"]: r["count"] for r in back.groupBy("series").count().collect()} == {
        "a": 270, "b": 5}
    # The short series has no reading 6 hours back, so there is nothing to fill from.
    empty = back.where("AT_TLAG_6hrs IS NULL")
    assert [(r["series"], r["count"]) for r in empty.groupBy("series").count().collect()] == [("b", 5)]


def test_days_first_are_told_by_the_whole_file(spark, tmp_path):
    start = datetime(2024, 7, 1)
    lines = [f"{(start + timedelta(hours=i)).strftime('%d/%m/%Y %H:%M')},{i % 11 + 0.5}" for i in range(720)]
    source = put(tmp_path / "days.csv", [f"{N.DATE},DO", *lines])
    fits = read_table(spark, files.daily_fit_file(spark, source, str(tmp_path / "fits")))
    days = sorted(r["date"] for r in fits.collect())
    assert len(days) == 31 and days[:30] == [(start + timedelta(days=i)).strftime("%Y-%m-%d") for i in range(30)]
