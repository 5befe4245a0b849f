"""Buckets by row count: a burst is cut, and nothing but the tasks changes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline.operators.lags import add_future_levels, add_time_lags, minutes_on
from gaugeline.operators.neighbourhood import near_events
from gaugeline.operators.sequence import fill_both_ways, mark_transitions, row_index, spacing, true_runs
from gaugeline.plans import timeline
from gaugeline.plans.timeline import BUCKET, Buckets, Lookup, bucketed, cut_buckets, look_up, suggest_buckets
from gaugeline.session import settle

LIMIT = 40
KEYS = ["site"]


@pytest.fixture(scope="module")
def burst(spark):
    """Hourly readings of three series over twelve days; two of them have a thousand times as many in one
    hour, with ties, gaps and missing values."""
    draw, start = random.Random(5), datetime(2024, 6, 28, 1)
    times = [(site, start + timedelta(hours=h)) for site in ("a", "b", None) for h in range(0, 288, 3)]
    for site, hour in (("a", 100), ("a", 279), (None, 23)):
        times += [(site, start + timedelta(hours=hour, seconds=draw.randrange(0, 3600, 3))) for _ in range(700)]
    rows = [(i, site, t, draw.choice([None, round(draw.random(), 3)]), float(draw.random() < 0.6))
            for i, (site, t) in enumerate(times)]
    df = spark.createDataFrame(rows, "id int, site string, at timestamp, DO double, `on` double")
    return settle(df.withColumn("at", F.col("at").cast("timestamp_ntz")))


@pytest.fixture(scope="module", params=["6 hours", "30 days"])
def cut(request, burst):
    """The width and the buckets cut from it."""
    got = cut_buckets(burst, "at", KEYS, request.param, LIMIT)
    assert isinstance(got, Buckets)
    return request.param, got


def test_no_bucket_is_over_the_limit(burst, cut):
    rows = bucketed(burst, "at", KEYS, cut[1])
    fullest = rows.groupBy(*KEYS, BUCKET).count()
    assert fullest.agg(F.max("count")).first()[0] <= LIMIT
    assert bucketed(burst, "at", KEYS, cut[0]).groupBy(*KEYS, BUCKET).count().agg(F.max("count")).first()[0] > LIMIT
    ends = rows.groupBy(*KEYS, BUCKET).agg(F.min("__pos").alias("low"), F.max("__pos").alias("high"))
    assert ends.where(f"low < {BUCKET}").isEmpty()
    after = F.lead(BUCKET).over(timeline.Window.partitionBy(*KEYS).orderBy(BUCKET))
    assert ends.withColumn("next", after).where("high >= next").isEmpty()


OPERATORS = {
    "lags": lambda df, **o: add_time_lags(df, {"l1": ("DO", 1), "l30": ("DO", 30), "o2": ("on", 2)}, **o),
    "futures": lambda df, **o: add_future_levels(df, "DO", (1, 7, 24), **o),
    "minutes": lambda df, **o: minutes_on(df, "on", {"m1": 1, "m5": 5, "m40": 40}, **o),
    "transitions": lambda df, **o: mark_transitions(df, "on", **o),
    "near": lambda df, **o: near_events(df.withColumn("e", F.col("id") % 97 == 0), "e", 2, **o),
    "spacing": lambda df, **o: spacing(df, **o),
    "index": lambda df, **o: row_index(df, "place", **o),
    "fill": lambda df, **o: fill_both_ways(df, ["DO"], **o),
    "runs": lambda df, **o: true_runs(df, "on", **o),
    "doubles": lambda df, **o: add_time_lags(
        df, {"l1": ("DO", 1)}, rolling={"s": ("on", 3), "t": ("on", 50)}, **o),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_same_results(burst, cut, name):
    options = dict(ts="at", keys=KEYS, tiebreak=["id"])
    plain = OPERATORS[name](burst, bucket=cut[0], **options)
    got = OPERATORS[name](burst, bucket=cut[1], **options)
    assert got.columns == plain.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_one_series_and_whole_numbers(burst):
    """Without keys, with whole sums, on positions that are no times."""
    df = burst.select("id", F.expr("unix_date(date(at)) * 24L + hour(at)").alias("hour"), F.lit(1).alias("one"))
    cut = cut_buckets(df, "hour", [], 100, 200)
    call = dict(ts="hour", sources=["id"], tiebreak=["id"], lookups=[Lookup("l", 5), Lookup("f", 3, True)],
                sums=[timeline.RollingSum("s", "one", 7), timeline.RollingSum("t", "one", 150)])
    assert isinstance(cut, Buckets) and cut.dense.count() > 0
    got, plain = look_up(df, bucket=cut, **call), look_up(df, bucket=100, **call)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_measured_buckets(spark, burst):
    few = burst.where("site = 'b'")
    assert suggest_buckets(few, "at", KEYS) == timeline.width_micros("365 days")
    assert cut_buckets(few.limit(0), "at", KEYS, "1 day", 1) == timeline.width_micros("1 day")
    # Hourly readings of two years and a burst within one hour: days, and narrower parts of one day.
    hours = spark.range(20_000).selectExpr("id * 3600 AS s").union(spark.range(5_000).selectExpr("7200000 + id % 3600"))
    df = hours.selectExpr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS at")
    got = suggest_buckets(df, "at", [], 2_000)
    assert isinstance(got, Buckets) and got.width == timeline.width_micros("1 day") and got.dense.count() == 1
    assert bucketed(df, "at", [], got).groupBy(BUCKET).count().agg(F.max("count")).first()[0] <= 2_000
    with pytest.raises(ValueError, match="do not serve"):
        bucketed(burst, "at", KEYS, got)


def test_rows_of_one_time_stay_together(spark):
    df = spark.range(500).selectExpr("timestamp_ntz'2024-01-01 00:00:00.5' AS at", "id")
    cut = cut_buckets(df, "at", [], "1 day", 10)
    assert bucketed(df, "at", [], cut).select(BUCKET).distinct().count() == 1
    assert row_index(df, "place", ts="at", tiebreak=["id"], bucket=cut).where("place = id").count() == 500
