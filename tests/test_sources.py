"""CSV and JSON in and out, series folders and the weather stream."""

import json
import os

import pytest

from gaugeline import names as N
from gaugeline.plans.weather import add_weather_lags, normalise_weather
from gaugeline.sources import tables as S
from gaugeline.streaming.weather import read_weather_stream, write_normalised


def put(path, text):
    path.write_text(text)
    return str(path)


def test_read(spark, tmp_path):
    path = put(tmp_path / "a.csv", ' DATE , DO,note\n2024-01-01,NaN,"a ""b"", c"\n,1.5,None\n')
    df = S.read_table(spark, path)
    assert df.columns == ["DATE", "DO", "note"]
    assert [tuple(r) for r in df.collect()] == [("2024-01-01", None, 'a "b", c'), (None, "1.5", None)]
    raw = S.read_text_table(spark, path)
    assert [tuple(r) for r in raw.collect()][1] == ("", "1.5", "None")
    assert tuple(S.table_size(raw).first()) == (2, 3)
    assert S.peek_targets(spark, path) == ["DO"]
    with pytest.raises(FileNotFoundError):
        S.read_table(spark, str(tmp_path / "gone.csv"))


def test_line_breaks_in_cells(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'DATE,note\n2024-01-01,"two\nlines"\n2024-01-02,x\n')
    rows = S.read_table(spark, path, multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("2024-01-01", "two\nlines"), ("2024-01-02", "x")]


def test_output_names(spark, tmp_path):
    assert S.default_output("/x/lake.v1.csv", N.LAKE_SUFFIX) == "/x/lake.v1_parsed_DOdeltas.csv"
    assert S.default_output("/x/lake", N.PARSED_SUFFIX) == "/x/lake_parsed.csv"


def test_write_guards(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, 'x "y"')], "a int, b string")
    source = str(tmp_path / "in.csv")
    for target in (source, str(tmp_path / "in"), f"file:{source}", f"{tmp_path}/./in.csv"):
        with pytest.raises(ValueError):
            S.write_table(df, target, source)
    out = S.write_table(df, str(tmp_path / "out"), source, order_by="a")
    assert out.endswith("out.csv")
    back = S.read_table(spark, out)
    assert [tuple(r) for r in back.collect()] == [("1", 'x "y"'), ("2", None)]
    with pytest.raises(Exception, match="(?i)exists"):
        S.write_table(df, out)


def test_reports_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1.0, ["a", "b"])], "mae double, features array<string>")
    paths = S.write_reports({"one": df.select("mae"), "two": df.select("mae")}, str(tmp_path))
    assert sorted(paths) == ["one", "two"] and all(os.path.isdir(p) for p in paths.values())
    folder = S.write_metrics(df, str(tmp_path / "metrics"))
    parts = [f for f in (tmp_path / "metrics").iterdir() if f.suffix == ".json"]
    assert json.loads("".join(f.read_text() for f in parts)) == {"mae": 1.0, "features": ["a", "b"]}


def test_series_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, warm in (("Hot Year", 20), ("Wet.v2", 10)):
        lines = [f"2001-06-01 {h:02d}:00:00,{warm + h},5,6,{h}" for h in range(8)]
        head = f"{N.DATE},{N.AIR_TEMP},{N.HUMIDITY},{N.PRESSURE},{N.HOUR}"
        put(folder / f"{name}.csv", "\n".join([head, *lines]))
    df = S.read_series_folder(spark, str(folder))
    assert {r["series"] for r in df.select("series").distinct().collect()} == {"Hot Year", "Wet.v2"}
    lagged = add_weather_lags(df, keys=["series"])
    out = S.write_by_series(lagged, str(tmp_path / "out"))
    assert sorted(d for d in os.listdir(out) if "=" in d) == ["series=Hot Year", "series=Wet.v2"]
    back = spark.read.option("header", True).csv(out)
    got = back.where("series = 'Hot Year' AND hour = '7'").first()
    assert [float(got[c]) for c in N.WEATHER_LAG_HOURS] == [26.0, 24.0, 21.0]


def test_folder_with_another_header_fails(spark, tmp_path):
    put(tmp_path / "a.csv", "DATE,x\n1,2\n")
    put(tmp_path / "b.csv", "x,DATE\n1,2\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        S.read_series_folder(spark, str(tmp_path)).collect()


def test_weather_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    schema = "valid string, tmpc string, relh string, mslp string"
    head = "valid,tmpc,relh,mslp\n"
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    for name, body in (("a", "2001-05-01 03:10,11,40,1000\n2001-07-01 00:00,1,2,M\n"),
                       ("b", "2001-09-30 23:30,12,40,1001\n")):
        put(landing / f"{name}.csv", head + body)
        stream = read_weather_stream(spark, str(landing), schema)
        write_normalised(stream, out, marks, once=True).awaitTermination(120)
    batch = normalise_weather(spark.read.schema(schema).option("header", True).csv(str(landing)))
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())
    assert batch.count() == 2


def test_folder_of_several_headers(spark, tmp_path):
    put(tmp_path / "a+b [1].csv", " DATE ,x\n1,2\n3,NaN\n")
    put(tmp_path / "b 100%.CSV", "x,DATE\n5,6\n")
    put(tmp_path / "c.csv", "DATE,y\n7,8\n")
    put(tmp_path / "empty.csv", "DATE,z\n")
    put(tmp_path / "notes.txt", "no table")
    (tmp_path / "series=d:e").mkdir()
    put(tmp_path / "series=d:e" / "part-1.csv", "DATE,x\n9,10\n")
    df = S.read_series_folder(spark, str(tmp_path), mixed=True)
    assert set(df.columns) == {"series", "DATE", "x", "y", "z"}
    got = sorted(tuple(r[c] for c in ("series", "DATE", "x", "y", "z")) for r in df.collect())
    assert got == [("a+b [1]", "1", "2", None, None), ("a+b [1]", "3", None, None, None),
                   ("b 100%", "6", "5", None, None), ("c", "7", None, "8", None), ("d:e", "9", "10", None, None)]
    with pytest.raises(FileNotFoundError):
        S.read_series_folder(spark, str(tmp_path / "series=d:e" / "none"), mixed=True)
    out = S.write_by_series(df.select("series", "DATE"), str(tmp_path / "out"))
    back = S.read_series_folder(spark, out)
    assert {r["series"] for r in back.collect()} == {"a+b [1]", "b 100%", "c", "d:e"}
