"""Dates read by the shapes of their column."""

import random
from datetime import datetime

import pytest

from gaugeline.functions import dates as D


def read(spark, texts, order=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, `a day` string")
    got = D.with_dates(df, "a day", order).orderBy("i").collect()
    return [r[1] for r in got], D.read_dates(df, "a day", order)


WHEN = datetime(2024, 7, 16, 21, 5, 9)
LAYOUTS = [
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%y %H:%M:%S",
    "%d.%m.%Y, %H:%M:%S", "%d-%b-%Y %H:%M:%S", "%d %B %Y %H:%M:%S", "%B %d, %Y %I:%M:%S%p", "%b %d %y %H:%M:%S",
    "%H:%M:%S %d/%m/%Y", "%I:%M:%S %p, %B %d, %Y", "%A, %d %B %Y %H:%M:%S", "%a %b %d %Y %H:%M:%S",
    "%Y%m%d %H:%M:%S", "%Y%m%d%H%M%S", "%Y%m%dT%H:%M:%S", "%Y %b %d %H:%M:%S", "%Y-%d-%m %H:%M:%S",
    "%H:%M:%S %Y%m%d", "%y.%m.%d %H:%M:%S",
]


def test_parts_in_any_order(spark):
    """All layouts in one column; 16 is no month, so every part has one order."""
    layouts = [x for x in LAYOUTS if x != "%y.%m.%d %H:%M:%S"]
    got, reading = read(spark, [WHEN.strftime(x) for x in layouts])
    assert got == [WHEN] * len(layouts)
    assert reading.unknown == 0 and reading.rows == len(layouts)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_random_times_of_one_layout(spark, layout):
    """A column of many times has days past 12, and years past 31, so its order is found."""
    draw = random.Random(layout)
    times = [datetime(2024 + draw.randrange(30) + 1, draw.randrange(12) + 1, draw.randrange(28) + 1,
                      draw.randrange(24), draw.randrange(60), draw.randrange(60)) for _ in range(200)]
    got, reading = read(spark, [t.strftime(layout) for t in times])
    assert got == times
    assert {s.decided for s in reading.shapes} <= {"only", "values"}


def test_the_whole_column_decides(spark):
    # One value alone reads as July 5; a later one shows that days come first, in all shapes alike.
    assert read(spark, ["05/07/2024"])[0] == [datetime(2024, 5, 7)]
    got, reading = read(spark, ["05/07/2024", "25/07/2024", "06/07/2024 10:30"])
    assert got == [datetime(2024, 7, 5), datetime(2024, 7, 25), datetime(2024, 7, 6, 10, 30)]
    assert [(s.shape, s.orders, s.decided) for s in reading.shapes] == [
        ("N/N/Y", ("dmy",), "values"), ("N/N/Y N:N", ("dmy",), "values")]
    assert [s.decided for s in read(spark, ["05/07/2024"])[1].shapes] == ["assumed"]
    got, reading = read(spark, ["05/07/2024"], "dmy")
    assert got == [datetime(2024, 7, 5)] and reading.shapes[0].decided == "given"


def test_no_order_suits_all(spark):
    got, reading = read(spark, ["05/07/2024", "25/07/2024", "07/25/2024", "31/31/2024"])
    assert got == [datetime(2024, 5, 7), datetime(2024, 7, 25), datetime(2024, 7, 25), None]
    assert reading.shapes[0].decided == "mixed" and reading.shapes[0].orders[:2] == ("mdy", "dmy")


def test_what_is_no_date(spark):
    texts = [None, "", " ", "soon", "T12:00", "n/n/y", "1/2/3/4", "2024-02-30", "13:00 pm", "x" * 500,
             "2024-07-16T21:05:09+02:00", "2024-07-16 21:05:09.25Z", "2024", " 7/4/76  9:20 ", "7/4/24 9:20 a.m."]
    got, reading = read(spark, texts)
    assert got[:10] == [None] * 10
    assert got[10:] == [WHEN, WHEN.replace(microsecond=250000), datetime(2024, 1, 1),
                        datetime(1976, 7, 4, 9, 20), datetime(2024, 7, 4, 9, 20)]
    assert reading.rows == len(texts) - 1
    report = {r["shape"]: r for r in reading.report(spark).collect()}
    assert report[""]["decided"] == "unknown" and report["N/N/N N:N"]["orders"] == "mdy"


def test_empty_column_and_other_types(spark):
    assert read(spark, [])[0] == [] and read(spark, [None, None])[0] == [None, None]
    df = spark.range(1).selectExpr("timestamp_ntz'2024-07-16 21:05:09' AS t")
    assert D.with_dates(df, "t").first()["t"] == WHEN
    with pytest.raises(ValueError, match="order"):
        D.read_dates(df.selectExpr("'x' AS t"), "t", "yyy")


def test_parsers_stay_in_the_jvm_and_count_in_tasks(spark):
    df = spark.range(100).selectExpr("'7/16/24 9:20' AS t")
    plan = D.shape_counts(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "partial_max" in plan
    assert "Exchange" not in D.with_dates(df, "t")._jdf.queryExecution().executedPlan().toString()
