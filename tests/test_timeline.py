"""Lookups and rolling sums against brute force, for bucket widths around the offsets."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import lags, sequence
from gaugeline.operators.neighbourhood import near_events
from gaugeline.operators.quantiles import exact_medians
from gaugeline.plans.timeline import Lookup, look_up, suggest_bucket

HOUR = 3_600_000_000
START = datetime(2024, 1, 1)


def series(seed, keys=3, size=60, before_epoch=False):
    """Readings with ties, gaps of days, missing values and one series that holds most rows."""
    rng = random.Random(seed)
    out = []
    base = datetime(1969, 12, 30) if before_epoch else START
    for key in range(keys):
        now = base + timedelta(minutes=rng.randrange(600))
        for _ in range(size * (6 if key == 0 else 1)):
            now += timedelta(minutes=rng.choice([0, 0, 1, 7, 30, 90, 3000 if rng.random() < 0.1 else 5]))
            value = None if rng.random() < 0.2 else round(rng.uniform(0, 9), 2)
            flag = None if rng.random() < 0.2 else float(rng.random() < 0.4)
            out.append((f"k{key}" if key else None, now, len(out), value, flag))
    rng.shuffle(out)
    return out


SCHEMA = "key string, ts timestamp_ntz, id int, value double, flag double"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def by_key(data, keyed):
    groups = {}
    for row in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0] if keyed else None, []).append(row)
    return groups


def expected(data, keyed, hours):
    out = {}
    for rows in by_key(data, keyed).values():
        for r in rows:
            step = timedelta(hours=hours)
            back = [s for s in rows if s[1] <= r[1] - step]
            ahead = [s for s in rows if s[1] >= r[1] + step]
            window = [s[4] for s in rows if r[1] - step < s[1] <= r[1] and s[4] is not None]
            out[r[2]] = (
                back[-1][3] if back else None,
                ahead[0][3] if ahead else None,
                sum(window) if window else None,
            )
    return out


@pytest.mark.parametrize("bucket", ["20 minutes", "1 hour", "1 day", "30 days"])
@pytest.mark.parametrize("keyed", [True, False])
def test_lags_futures_and_sums(spark, bucket, keyed):
    data = series(7)
    options = dict(ts="ts", keys=["key"] if keyed else [], tiebreak=["id"], bucket=bucket)
    df = frame(spark, data)
    lagged = lags.add_time_lags(
        df, {"l1": ("value", 1), "l6": ("value", 6)}, rolling={"s1": ("flag", 1), "s6": ("flag", 6)},
        **options,
    )
    both = lags.add_future_levels(lagged, "value", (1, 6), **options)
    got = {r["id"]: r for r in both.collect()}
    assert len(got) == len(data)
    for h in (1, 6):
        for i, (back, ahead, total) in expected(data, keyed, h).items():
            assert got[i][f"l{h}"] == back
            assert got[i][f"DO_{h}h"] == ahead
            assert got[i][f"s{h}"] == total
            now = got[i]["value"]
            change = None if now is None or ahead is None else pytest.approx(ahead - now, abs=1e-9)
            assert got[i][f"DO_delta_{h}h"] == change


@pytest.mark.parametrize("bucket", ["7 minutes", "1 hour", "1 day"])
def test_sums_of_any_number(spark, bucket):
    rng = random.Random(12)
    data = [(f"k{i % 3}", START + timedelta(minutes=rng.randrange(4000)), i,
             None if rng.random() < 0.2 else rng.uniform(-5, 5), None) for i in range(300)]
    got = {r["id"]: r for r in lags.add_time_lags(
        frame(spark, data), {"l": ("value", 1)}, ts="ts", keys=["key"], tiebreak=["id"], bucket=bucket,
        rolling={"s1": ("value", 1), "s2": ("value", 2), "s7": ("value", 7)}).collect()}
    for rows in by_key(data, True).values():
        for r in rows:
            for h in (1, 2, 7):
                window = [x[3] for x in rows if r[1] - timedelta(hours=h) < x[1] <= r[1] and x[3] is not None]
                want = pytest.approx(sum(window), abs=1e-9) if window else None
                assert got[r[2]][f"s{h}"] == want


def test_large_and_infinite_values_leave_nothing_behind(spark):
    for first in (1e17, float("inf")):
        data = [("a", START + timedelta(hours=i), i, v, None) for i, v in enumerate([first, 1.0, 2.0, 3.0])]
        got = lags.add_time_lags(frame(spark, data), {}, ts="ts", tiebreak=["id"],
                                 rolling={"s": ("value", 1)}).collect()
        assert {r["id"]: r["s"] for r in got} == {0: first, 1: 1.0, 2: 2.0, 3: 3.0}


def test_times_before_1970(spark):
    data = series(3, before_epoch=True)
    got = lags.add_time_lags(
        frame(spark, data), {"l3": ("value", 3)}, ts="ts", keys=["key"], tiebreak=["id"],
        bucket="2 hours",
    )
    want = expected(data, True, 3)
    assert {r["id"]: r["l3"] for r in got.collect()} == {i: v[0] for i, v in want.items()}


def test_lookup_picks_the_row_before_it_reads_the_value(spark):
    data = [("a", START, 1, 5.0, None), ("a", START + timedelta(minutes=10), 2, None, None),
            ("a", START + timedelta(hours=2), 3, 7.0, None)]
    got = lags.add_time_lags(
        frame(spark, data), {"l1": ("value", 1)}, ts="ts", tiebreak=["id"]
    ).collect()
    assert {r["id"]: r["l1"] for r in got}[3] is None


def test_lookup_has_no_tolerance(spark):
    data = [("a", START, 1, 5.0, None), ("a", START + timedelta(days=335), 2, 6.0, None)]
    got = lags.add_time_lags(
        frame(spark, data), {"l1": ("value", 1)}, ts="ts", tiebreak=["id"]
    ).collect()
    assert {r["id"]: r["l1"] for r in got} == {1: None, 2: 5.0}


def test_keys_do_not_mix(spark):
    data = series(11)
    alone = [r for r in data if r[0] == "k1"]
    options = dict(ts="ts", keys=["key"], tiebreak=["id"])
    whole = lags.add_time_lags(frame(spark, data), {"l": ("value", 1)}, **options)
    part = lags.add_time_lags(frame(spark, alone), {"l": ("value", 1)}, **options)
    assert sorted(whole.where("key = 'k1'").collect()) == sorted(part.collect())


@pytest.mark.parametrize("bucket", ["1 hour", "1 day"])
def test_row_order_operators(spark, bucket):
    data = series(5)
    options = dict(ts="ts", keys=["key"], tiebreak=["id"], bucket=bucket)
    df = frame(spark, data)
    changed = {r["id"]: r["transition"] for r in
               sequence.mark_transitions(df, "flag", **options).collect()}
    place = {r["id"]: r["n"] for r in sequence.row_index(df, "n", **options).collect()}
    filled = {r["id"]: r["value"] for r in
              sequence.fill_both_ways(df, ["value", "flag"], **options).collect()}
    runs = {(r["key"], r["start"]): (r["end"], r["length"], r["start_ts"], r["end_ts"])
            for r in sequence.true_runs(df, "flag", rows_per_bucket=5, **options).collect()}
    near = {r["id"] for r in near_events(
        sequence.mark_transitions(df, "flag", **options), "transition", 2, **options).collect()}
    want_runs = {}
    for key, group in by_key(data, True).items():
        known = [r[3] for r in group if r[3] is not None]
        last, open_run = known[0], None
        events = []
        for i, r in enumerate(group):
            flag, before = r[4] or 0, (group[i - 1][4] or 0) if i else None
            assert changed[r[2]] == (i > 0 and flag != before)
            assert place[r[2]] == i
            if changed[r[2]]:
                events.append(r[1])
            last = r[3] if r[3] is not None else last
            assert filled[r[2]] == last
            if flag:
                open_run = i if open_run is None else open_run
                want_runs[key, open_run] = (
                    i + 1, i + 1 - open_run, group[open_run][1], r[1])
            else:
                open_run = None
        for r in group:
            close = any(abs(r[1] - t) <= timedelta(hours=2) for t in events)
            assert (r[2] in near) == close
    assert runs == want_runs


def test_exactly_at_reach_is_near(spark):
    step = timedelta(hours=12)
    data = [("a", START - step, 0, 1.0, 0.0), ("a", START, 1, 1.0, 1.0),
            ("a", START + step, 2, 1.0, 1.0),
            ("a", START + step + timedelta(microseconds=1), 3, 1.0, 1.0)]
    marked = sequence.mark_transitions(frame(spark, data), "flag", ts="ts", tiebreak=["id"])
    near = near_events(marked, "transition", ts="ts", tiebreak=["id"])
    assert sorted(r["id"] for r in near.collect()) == [0, 1, 2]


def test_medians(spark):
    rng = random.Random(1)
    values = [rng.choice([0.0, -0.0, -3.5, 1e-300, 1e300, rng.gauss(0, 5), rng.gauss(0, 5)])
              for _ in range(501)]
    data = [("odd", v) for v in values] + [("even", v) for v in values[:-1]] + [("none", None)]
    df = spark.createDataFrame(data, "key string, v double")
    got = {r["key"]: r["m"] for r in exact_medians(df, {"v": "m"}, keys=["key"]).collect()}
    odd, even = sorted(values), sorted(values[:-1])
    assert got == {"odd": odd[250], "even": (even[249] + even[250]) / 2}
    assert exact_medians(df.where("key = 'none'"), {"v": "m"}).first()["m"] is None


def test_median_spacing_of_one_row_is_missing(spark):
    df = frame(spark, [("a", START, 1, 1.0, 1.0)])
    got = lags.minutes_on(df, "flag", {"on": 1}, ts="ts", keys=["key"], tiebreak=["id"]).collect()
    assert [r["on"] for r in got] == [None]


def test_minutes_on_counts_rows_of_equal_time_for_each_other(spark):
    data = [("a", START + timedelta(minutes=m), i, 1.0, 1.0) for i, m in enumerate([0, 30, 30, 90])]
    got = lags.minutes_on(frame(spark, data), "flag", {"on": 1}, ts="ts", tiebreak=["id"]).collect()
    assert {r["id"]: r["on"] for r in got} == {0: 30.0, 1: 90.0, 2: 90.0, 3: 30.0}


def test_bucket_follows_the_fullest_cell(spark):
    df = spark.range(3000).select(
        (F.lit(START) + F.make_dt_interval(secs=F.col("id"))).alias("ts"))
    assert suggest_bucket(df, "ts", rows_per_bucket=5000) == "365 days"
    assert suggest_bucket(df, "ts", rows_per_bucket=2999) == "1 minute"
    found = look_up(df, ts="ts", lookups=[Lookup("x", 10_000_000)], bucket="auto")
    assert found.where("x IS NOT NULL").count() == 2990


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_of_one_long_series(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = lags.add_time_lags(df, {"l": ("value", 1)}, ts="ts", tiebreak=["event_id"])
    plan = explained(out)
    assert "Join" not in plan and "CartesianProduct" not in plan
    # One task only ever sees the per-bucket summaries.
    assert plan.count("SinglePartition") == 1
    # The fold of the rows is a hash aggregate: no row is sorted before it moves.
    assert "SortAggregate" not in plan
    assert "props" not in explained(out.select("l"))


def test_the_lake_plan_reads_its_source_once(spark):
    from gaugeline.queries.catalog import QUERIES

    reads = []
    plain = type(spark.read).parquet

    def counted(self, *paths, **options):
        reads.extend(p for p in paths if "events.parquet" in p)
        return plain(self, *paths, **options)

    type(spark.read).parquet = counted
    try:
        plan = explained(QUERIES["lake_feature_table"](spark, "/root/testdata/sf0.001"))
    finally:
        type(spark.read).parquet = plain
    # What is left to run starts from the written tables; no row is sorted before it moves.
    assert len(reads) == 1 and "events.parquet" not in plan
    assert "SortAggregate" not in plan


def test_medians_of_values_that_share_a_bin(spark):
    """A million distinct values in one narrow bin: it is cut until a task gets few of them."""
    from gaugeline.operators import quantiles

    df = spark.range(1_000_001).select(
        (F.lit(1013.0) + F.col("id") / 10_000_000).alias("v"),
        F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("w"),
        F.when(F.col("id") < 2, F.lit(float("inf"))).otherwise(-1e308 * (F.col("id") % 2)).alias("x"),
        (F.col("id") % 2).alias("key"))
    got = exact_medians(df, {"v": "v", "w": "w", "x": "x"}, bin_rows=1000).first()
    assert got["v"] == 1013.0 + 500_000 / 10_000_000 and got["w"] == 5.0 and got["x"] == 0.0
    long = df.select(F.lit(0).alias("__which"), "key", F.col("v").alias("__value"))
    bins = quantiles.middle_bins(long, ["key"], 1000).collect()
    assert {r["key"] for r in bins} == {0, 1} and all(r["n"] <= 1000 for r in bins)
    by_key = {r["key"]: r["m"] for r in exact_medians(df, {"v": "m"}, keys=["key"], bin_rows=1000).collect()}
    ids = {0: (500_000, 500_000), 1: (499_999, 500_001)}
    for key, (low, high) in ids.items():
        assert by_key[key] == ((1013.0 + low / 10_000_000) + (1013.0 + high / 10_000_000)) / 2
