"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline import names as N
from gaugeline.functions.columns import date_column, level_column, prediction_column, reorder
from gaugeline.functions.time import ref
from gaugeline.functions.dates import read_dates, with_dates
from gaugeline.functions.values import (
    calendar_features, ceil_hour, count_unreadable_dates, date_text, halve_positive, hours_of_day,
    number, timestamp, with_numbers, with_timestamp,
)
from gaugeline.operators import clean, climate, lags, sequence
from gaugeline.operators.boosting import (
    Node, QuantileModel, train_quantile, train_targets, train_tiers, training_table,
)
from gaugeline.operators.coverage import daily_coverage, day_blocks
from gaugeline.operators.fit import append_fit_summary, daily_fit
from gaugeline.operators.holdout import holdout, nested_holdout, split_counts, week_key
from gaugeline.operators.neighbourhood import near_events, pair_predictions
from gaugeline.operators.quantiles import exact_medians
from gaugeline.operators.scoring import (
    impute, mean_absolute_error, metrics_report, score, score_all, score_tiers,
)
from gaugeline.plans.files import weather_lag_folder
from gaugeline.plans.lake import lake_features, lake_lag_table
from gaugeline.plans.reports import transition_table
from gaugeline.plans.timeline import cut_buckets
from gaugeline.plans.weather import (
    add_weather_lags, normalise_weather, prepare_parsed, yearly_analytics,
)
from gaugeline.queries.inputs import (
    LAKE_SQL, LINES_SQL, WEATHER_SQL, lake, priced_lines, raw_weather, table,
)
from gaugeline.session import settle, shared_folder
from gaugeline.sources.registry import delete_model, list_models, load_model, save_model
from gaugeline.sources.tables import (
    default_output, peek_targets, read_table, read_text_table, table_size, write_by_series, write_metrics,
    write_reports, write_table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def typed_lake(spark: SparkSession, folder: str) -> DataFrame:
    return with_numbers(lake(spark, folder), [N.AIR_TEMP])


def snake(df: DataFrame) -> DataFrame:
    """Output names without blanks and brackets, as the SQL side has them."""
    plain = {N.DATE: "d", N.LEVEL: "lvl", N.AIR_TEMP: "air", N.HUMIDITY: "rh", N.PRESSURE: "mb",
             N.FLAG: "flag"}
    return df.select(*[ref(c).alias(plain.get(c, c)) for c in df.columns])


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(ref(c), places) for c in columns})


def report(df: DataFrame) -> DataFrame:
    """Days as text, as reports have them, and gaps as doubles, which may be missing."""
    days = [c for c in ("calendar_date", "start_date", "end_date") if c in df.columns]
    gaps = [c for c in df.columns if c.startswith("gap_")]
    return df.withColumns(
        {c: ref(c).cast("string") for c in days} | {c: ref(c).cast("double") for c in gaps}
    )


# ---------------------------------------------------------------- values and filters


@registered("""
SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN value END AS num FROM events
""")
def parsed_numbers(spark: SparkSession, folder: str) -> DataFrame:
    kind, text = F.col("event_type"), F.col("value").cast("string")
    texts = table(spark, folder, "events").select(
        "event_id",
        F.when(kind == "click", text)
        .when(kind == "error", F.concat(F.lit(" "), text, F.lit("e0 ")))
        .when(kind == "view", F.concat(text, F.lit("D")))
        .when(kind == "signup", F.lit("NaN"))
        .otherwise(F.lit("1,000")).alias("cell"),
    )
    return texts.select("event_id", number(texts, "cell").alias("num"))


def _date_texts(spark: SparkSession, folder: str) -> DataFrame:
    day, kind = F.col("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(kind == "1", F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "2", F.date_format(day, "M/d/yyyy H:mm"))
        .when(kind == "3", F.concat(F.lit(" "), F.date_format(day, "yyyy-MM-dd")))
        .when(kind == "4", F.date_format(day, "M/d/yyyy"))
        .otherwise(F.lit("no date")).alias(N.DATE),
    )


@registered("""
SELECT o_orderkey, CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderdate END AS d FROM orders
""")
def parsed_dates(spark: SparkSession, folder: str) -> DataFrame:
    texts = _date_texts(spark, folder)
    return snake(with_timestamp(texts, date_column(texts.columns)))


_LAYOUTS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "M/d/yy h:mm a", "MM/dd/yyyy hh:mm a",
    "dd-MMM-yyyy HH:mm", "MMM d, yyyy", "yyyyMMdd", "M-d-yy H:mm", "d MMM yyyy", "M/d/yyyy H:mm:ss",
)


@registered(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % {len(_LAYOUTS)} IN (5, 6, 8) THEN o_orderdate
  ELSE o_orderdate + to_minutes((o_orderkey % 1440)::INTEGER) END AS d FROM orders
""")
def parsed_date_layouts(spark: SparkSession, folder: str) -> DataFrame:
    """Dates written in all layouts, some without a time of day."""
    minutes = F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    when, text = F.col("o_orderdate") + minutes, F.lit(None).cast("string")
    for i, layout in enumerate(_LAYOUTS):
        text = F.when(F.col("o_orderkey") % len(_LAYOUTS) == i, F.date_format(when, layout)).otherwise(text)
    rows = table(spark, folder, "orders").select("o_orderkey", text.alias(N.DATE))
    return snake(with_timestamp(rows, N.DATE))


# Layouts by the remainder of the key: formatter, shape with a short and with a full month name, orders.
_SHAPES = (
    ("dd/MM/yyyy HH:mm", "N/N/Y N:N", "N/N/Y N:N", "dmy", "values"),
    ("HH:mm d/M/yyyy", "N:N N/N/Y", "N:N N/N/Y", "dmy", "values"),
    ("EEEE, d MMMM yyyy H:mm", "W, N S Y N:N", "W, N B Y N:N", "dmy", "only"),
    ("yyyy.dd.MM HH:mm", "Y.N.N N:N", "Y.N.N N:N", "ydm", "values"),
    ("MMMM d, yyyy h:mm a", "S N, Y N:N P", "B N, Y N:N P", "mdy", "only"),
    ("yyyyMMddHHmmss", "E", "E", "ymd", "only"),
    ("EEE MMM d yyyy HH:mm", "W S N Y N:N", "W S N Y N:N", "mdy", "only"),
    ("h:mm a, d-MMM-yyyy", "N:N P, N-S-Y", "N:N P, N-S-Y", "dmy", "only"),
)


def _shaped_texts(spark: SparkSession, folder: str) -> DataFrame:
    minutes = F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    when, text = F.col("o_orderdate") + minutes, F.lit("no date")
    for i, (layout, *_) in enumerate(_SHAPES):
        text = F.when(F.col("o_orderkey") % (len(_SHAPES) + 1) == i, F.date_format(when, layout)).otherwise(text)
    return table(spark, folder, "orders").select("o_orderkey", text.alias(N.DATE))


@registered(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % {len(_SHAPES) + 1} < {len(_SHAPES)}
  THEN o_orderdate + to_minutes((o_orderkey % 1440)::INTEGER) END AS d FROM orders
""")
def dates_by_column(spark: SparkSession, folder: str) -> DataFrame:
    """Layouts with their parts in many orders; that days come first is told by the whole column."""
    return snake(with_dates(_shaped_texts(spark, folder), N.DATE))


@registered(f"""
WITH layout(i, short, long, orders, decided) AS (VALUES {", ".join(
    f"({i}, '{short}', '{long}', '{orders}', '{decided}')"
    for i, (_, short, long, orders, decided) in enumerate((*_SHAPES, ("", "", "", "", "unknown"))))})
SELECT CASE WHEN month(o_orderdate) = 5 THEN short ELSE long END AS shape, count(*) AS rows, orders, decided
FROM orders JOIN layout ON o_orderkey % {len(_SHAPES) + 1} = i GROUP BY ALL
""")
def date_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """What the column of `dates_by_column` holds and how each shape is read."""
    return read_dates(_shaped_texts(spark, folder), N.DATE).report(spark)


@registered("""
SELECT count(*) AS total, count(*) FILTER (WHERE o_orderpriority LIKE '5%') AS dropped FROM orders
""")
def unreadable_dates(spark: SparkSession, folder: str) -> DataFrame:
    return count_unreadable_dates(_date_texts(spark, folder), N.DATE)


@registered("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '7' ELSE hour(
  o_orderdate + to_minutes((o_orderkey % 1440)::INTEGER))::VARCHAR END AS hour FROM orders
""")
def filled_hours(spark: SparkSession, folder: str) -> DataFrame:
    minutes = F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    status = F.col("o_orderstatus")
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        (F.col("o_orderdate") + minutes).alias(N.DATE),
        F.when(status == "P", "7").when(status == "F", " ").alias(N.HOUR),
    )
    return clean.fill_hour(rows, N.DATE).select("o_orderkey", N.HOUR)


@registered("""
SELECT event_id, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day,
  dayofyear(ts)::INTEGER AS dayofyear, isoyear(ts)::VARCHAR || '-W' || week(ts)::VARCHAR AS week,
  round(hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0, 6) AS time_h,
  strftime(date_trunc('hour', ts + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND),
    '%Y-%m-%d %H:%M:%S') AS ceiled
FROM events
""")
def calendar_parts(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("ts")
    rows = calendar_features(table(spark, folder, "events"), "ts").select(
        "event_id", "year", "month", "day", "dayofyear", week_key(ts).alias("week"),
        hours_of_day(ts).alias("time_h"), date_text(ceil_hour(ts)).alias("ceiled"),
    )
    return rounded(rows, "time_h")


@registered("""
SELECT event_id, round(CASE WHEN value > 10 THEN (value - 10) * 0.5 ELSE value - 10 END, 6) AS eff
FROM events
""")
def halved_gains(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    return rounded(
        rows.select("event_id", halve_positive(F.col("value") - 10).alias("eff")), "eff"
    )


@registered(f"""
WITH {LAKE_SQL} SELECT event_id, lvl FROM lake WHERE lvl IS NULL OR lvl <> 0
""")
def nonzero_levels(spark: SparkSession, folder: str) -> DataFrame:
    readings = lake(spark, folder)
    value = level_column(readings.columns)
    kept = clean.drop_zero_level(clean.drop_undated(readings, N.DATE), value)
    return snake(kept.select("event_id", value))


@registered(f"""
WITH {WEATHER_SQL} SELECT station, strftime(d, '%Y-%m-%d %H:%M:%S') AS d, air, rh, mb,
  hour(d)::DOUBLE AS hour FROM weather
""")
def weather_normalised(spark: SparkSession, folder: str) -> DataFrame:
    parsed = normalise_weather(raw_weather(spark, folder), keep=["station"])
    return snake(with_numbers(parsed, [N.AIR_TEMP, N.HUMIDITY, N.PRESSURE]))


@registered("""
SELECT o_orderkey FROM orders WHERE month(o_orderdate) IN (6, 7, 8)
""")
def summer_rows(spark: SparkSession, folder: str) -> DataFrame:
    return clean.in_months(table(spark, folder, "orders"), "o_orderdate").select("o_orderkey")


@registered(f"""
WITH {LAKE_SQL}, m AS (SELECT quantile_cont(air, 0.5) AS air FROM lake)
SELECT event_id, round(coalesce(lake.air, m.air), 6) AS air FROM lake, m
""")
def imputed_air(spark: SparkSession, folder: str) -> DataFrame:
    rows = typed_lake(spark, folder)
    median = exact_medians(rows, {N.AIR_TEMP: "median"}).first()["median"]
    return rounded(snake(impute(rows, {N.AIR_TEMP: median}).select("event_id", N.AIR_TEMP)), "air")


# ---------------------------------------------------------------- sources and sinks


def _as_csv(spark: SparkSession, folder: str) -> str:
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(" o_orderkey "), "o_totalprice", "o_orderdate",
        F.when(F.col("o_orderstatus") == "P", "a, \"b\"").otherwise("NaN").alias("note"),
    )
    return write_table(rows, f"{shared_folder(spark)}/gaugeline-csv-{uuid.uuid4().hex}")


@registered("""
SELECT o_orderkey, o_totalprice, o_orderdate,
  CASE WHEN o_orderstatus = 'P' THEN 'a, "b"' END AS note FROM orders
""")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    back = read_table(spark, _as_csv(spark, folder))
    return back.select(
        number(back, "o_orderkey").cast("bigint").alias("o_orderkey"),
        number(back, "o_totalprice").alias("o_totalprice"),
        timestamp(back, "o_orderdate").alias("o_orderdate"),
        "note",
    )


@registered("""
SELECT count(*) AS rows, 4 AS columns, count(*) FILTER (WHERE o_orderstatus <> 'P') AS nan_texts
FROM orders
""")
def csv_text_size(spark: SparkSession, folder: str) -> DataFrame:
    back = read_text_table(spark, _as_csv(spark, folder))
    kept = back.agg(F.count_if(F.col("note") == "NaN")).scalar()
    return table_size(back).withColumn("nan_texts", kept)


@registered("""
SELECT doc_id, lang, length(t) - length(replace(t, chr(10), '')) AS breaks, sha256(t) AS text_sha256
FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)
""")
def quoted_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with line breaks and quotes written as cells, and read back by several tasks a file."""
    out = f"{shared_folder(spark).rstrip('/')}/gaugeline-quoted-{uuid.uuid4().hex}.csv"
    rows = table(spark, folder, "documents").select("doc_id", "lang", "text")
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False).csv(out)
    back = read_text_table(spark, out, multi_line=True)
    return back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang",
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("bigint").alias("breaks"),
        F.sha2("text", 256).alias("text_sha256"))


# ---------------------------------------------------------------- lags, futures, rolling sums


def _asof(source: str, hours: int, keys: str, forward: bool = False, value: str = "lvl") -> str:
    """DuckDB as-of join of `source` with itself."""
    on = f"a.{keys} = b.{keys} AND " if keys else ""
    when = f"a.d + INTERVAL {hours} HOUR <= b.d" if forward else f"a.d - INTERVAL {hours} HOUR >= b.d"
    return (f"SELECT a.event_id, b.lvl, b.air FROM {source} a ASOF LEFT JOIN {source} b "
            f"ON {on}{when}")


def _lags_sql(keys: str) -> str:
    return f"""
WITH {LAKE_SQL}
SELECT l.event_id, x1.lvl AS "DO_TLAG_15", x3.lvl AS "DO_TLAG_30", x6.lvl AS "DO_TLAG_60",
  x1.air AS "AT_TLAG_15", x3.air AS "AT_TLAG_30", x6.air AS "AT_TLAG_60"
FROM lake l JOIN ({_asof('lake', 1, keys)}) x1 USING (event_id)
JOIN ({_asof('lake', 3, keys)}) x3 USING (event_id)
JOIN ({_asof('lake', 6, keys)}) x6 USING (event_id)
"""


def _series(keys: list[str]) -> dict:
    """A site has some dozens of readings a month, all sites together thousands a day."""
    return dict(ts=N.DATE, keys=keys, bucket="30 days" if keys else "1 day")


_SITE = dict(_series(["site"]), tiebreak=["event_id"])


def _lags(rows: DataFrame, keys: list[str]) -> DataFrame:
    wanted = lags.lake_lags(N.LEVEL)
    out = lags.add_time_lags(rows, wanted, tiebreak=["event_id"], **_series(keys))
    return out.select("event_id", *wanted)


@registered(_lags_sql("site"))
def lag_features(spark: SparkSession, folder: str) -> DataFrame:
    return _lags(typed_lake(spark, folder), ["site"])


@registered(_lags_sql(""))
def lag_features_global(spark: SparkSession, folder: str) -> DataFrame:
    return _lags(typed_lake(spark, folder), [])


@registered(_lags_sql(""))
def lag_features_by_count(spark: SparkSession, folder: str) -> DataFrame:
    """One series in buckets of a year, those with more than 2,000 rows cut."""
    rows, wanted = settle(typed_lake(spark, folder)), lags.lake_lags(N.LEVEL)
    cut = cut_buckets(rows, N.DATE, [], "365 days", 2_000)
    out = lags.add_time_lags(rows, wanted, ts=N.DATE, tiebreak=["event_id"], bucket=cut)
    return out.select("event_id", *wanted)


def _future_sql(keys: str) -> str:
    columns, joins = [], []
    for h in N.HORIZONS:
        columns.append(f'round(x{h}.lvl - l.lvl, 6) AS "DO_delta_{h}h", x{h}.lvl AS "DO_{h}h"')
        joins.append(f"JOIN ({_asof('lake', h, keys, True)}) x{h} USING (event_id)")
    return f"WITH {LAKE_SQL} SELECT l.event_id, {', '.join(columns)} FROM lake l {' '.join(joins)}"


def _futures(rows: DataFrame, keys: list[str]) -> DataFrame:
    out = lags.add_future_levels(rows, N.LEVEL, tiebreak=["event_id"], **_series(keys))
    changes = [f"{N.DELTA_PREFIX}{h}h" for h in N.HORIZONS]
    return rounded(
        out.select("event_id", *changes, *[lags.level_name(h) for h in N.HORIZONS]), *changes
    )


@registered(_future_sql("site"))
def future_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return _futures(lake(spark, folder), ["site"])


@registered(_future_sql(""))
def future_deltas_global(spark: SparkSession, folder: str) -> DataFrame:
    return _futures(lake(spark, folder), [])


def _on_sql(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    sums = ", ".join(
        f"sum(flag) OVER ({part} ORDER BY d RANGE BETWEEN INTERVAL {h} HOUR - INTERVAL 1 "
        f"MICROSECOND PRECEDING AND CURRENT ROW) AS s{h}" for h in (1, 3, 6)
    )
    group = f"GROUP BY {keys}" if keys else ""
    join = f"LEFT JOIN med USING ({keys})" if keys else "CROSS JOIN med"
    key = f"{keys}," if keys else ""
    return f"""
WITH {LAKE_SQL},
gaps AS (SELECT {key} (epoch_us(d) - lag(epoch_us(d)) OVER ({part} ORDER BY d)) / 60000000.0 AS g
  FROM lake),
med AS (SELECT {key} quantile_cont(g, 0.5) AS m FROM gaps {group}),
rolled AS (SELECT event_id, {key} {sums} FROM lake)
SELECT event_id, round(s1 * m, 6) AS "Aerator_TLAG_15", round(s3 * m, 6) AS "Aerator_TLAG_30",
  round(s6 * m, 6) AS "Aerator_TLAG_60" FROM rolled {join}
"""


def _on(rows: DataFrame, keys: list[str]) -> DataFrame:
    outputs = {N.FLAG_LAG_PREFIX + s: h for s, h in N.LAKE_LAG_HOURS.items()}
    out = lags.minutes_on(rows, N.FLAG, outputs, tiebreak=["event_id"], **_series(keys))
    return rounded(out.select("event_id", *outputs), *outputs)


@registered(_on_sql("site"))
def minutes_on(spark: SparkSession, folder: str) -> DataFrame:
    return _on(lake(spark, folder), ["site"])


@registered(_on_sql(""))
def minutes_on_global(spark: SparkSession, folder: str) -> DataFrame:
    return _on(lake(spark, folder), [])


@registered(f"""
WITH {LINES_SQL}
SELECT l_suppkey, l_orderkey, l_linenumber, round(sum(price) OVER (PARTITION BY l_suppkey ORDER BY d
  RANGE BETWEEN INTERVAL 720 HOUR - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW), 2) AS month_total
FROM lines
""")
def rolling_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Prices, which are no flags, summed over 30 days."""
    found = lags.add_time_lags(
        priced_lines(spark, folder).withColumn("price", F.col("price").cast("double")), {}, ts=N.DATE,
        keys=["l_suppkey"], tiebreak=["l_orderkey", "l_linenumber"], bucket="365 days",
        rolling={"month_total": ("price", 720)},
    )
    return rounded(found.select("l_suppkey", "l_orderkey", "l_linenumber", "month_total"),
                   "month_total", places=2)


@registered(f"""
WITH {LINES_SQL}, gaps AS (
  SELECT l_suppkey, (epoch_us(d) - lag(epoch_us(d)) OVER (PARTITION BY l_suppkey ORDER BY d))
    / 60000000.0 AS g FROM lines)
SELECT l_suppkey, round(quantile_cont(g, 0.5), 6) AS median_minutes FROM gaps GROUP BY l_suppkey
""")
def spacing_medians(spark: SparkSession, folder: str) -> DataFrame:
    rows = priced_lines(spark, folder)
    found = sequence.median_spacing(rows, ts=N.DATE, keys=["l_suppkey"], bucket="365 days")
    return rounded(found, "median_minutes")


@registered(f"""
WITH {LINES_SQL}, gaps AS (
  SELECT (epoch_us(d) - lag(epoch_us(d)) OVER (ORDER BY d)) / 60000000.0 AS g FROM lines)
SELECT round(quantile_cont(g, 0.5), 6) AS median_minutes FROM gaps
""")
def spacing_median_global(spark: SparkSession, folder: str) -> DataFrame:
    rows = priced_lines(spark, folder)
    found = sequence.median_spacing(
        rows, ts=N.DATE, bucket="7 days"
    )
    return rounded(found, "median_minutes")


@registered(f"""
WITH {LINES_SQL},
firsts AS (SELECT * FROM lines QUALIFY row_number() OVER (
  PARTITION BY l_suppkey, d ORDER BY l_orderkey, l_linenumber) = 1),
lasts AS (SELECT * FROM lines QUALIFY row_number() OVER (
  PARTITION BY l_suppkey, d ORDER BY l_orderkey DESC, l_linenumber DESC) = 1)
SELECT a.l_suppkey, a.l_orderkey, a.l_linenumber, b.price AS before_24h, c.price AS after_24h
FROM lines a
ASOF LEFT JOIN lasts b ON a.l_suppkey = b.l_suppkey AND a.d - INTERVAL 24 HOUR >= b.d
ASOF LEFT JOIN firsts c ON a.l_suppkey = c.l_suppkey AND a.d + INTERVAL 24 HOUR <= c.d
""")
def supplier_price_lags(spark: SparkSession, folder: str) -> DataFrame:
    """Backward and forward as-of over `lineitem`, with ties, in one shuffle."""
    from gaugeline.plans.timeline import Lookup, look_up

    day = 24 * 3_600_000_000
    found = look_up(
        priced_lines(spark, folder), ts=N.DATE, sources=["price"],
        lookups=[Lookup("b", day), Lookup("c", day, forward=True)],
        keys=["l_suppkey"], tiebreak=["l_orderkey", "l_linenumber"], bucket="365 days",
    )
    return found.select("l_suppkey", "l_orderkey", "l_linenumber",
                        F.col("b.price").alias("before_24h"), F.col("c.price").alias("after_24h"))


_WEATHER_LAGS_SQL = f"""
WITH {WEATHER_SQL},
lasts AS (SELECT * FROM weather QUALIFY row_number() OVER (
  PARTITION BY station, d ORDER BY o_orderkey DESC) = 1),
lagged AS (
  SELECT a.o_orderkey, a.station, a.d, a.air, b1.air AS l1, b3.air AS l3, b6.air AS l6
  FROM weather a
  ASOF LEFT JOIN lasts b1 ON a.station = b1.station AND a.d - INTERVAL 1 HOUR >= b1.d
  ASOF LEFT JOIN lasts b3 ON a.station = b3.station AND a.d - INTERVAL 3 HOUR >= b3.d
  ASOF LEFT JOIN lasts b6 ON a.station = b6.station AND a.d - INTERVAL 6 HOUR >= b6.d)
SELECT o_orderkey, station, d, air,
  coalesce(last_value(l1 IGNORE NULLS) OVER up, first_value(l1 IGNORE NULLS) OVER down) AS "AT_TLAG_1hr",
  coalesce(last_value(l3 IGNORE NULLS) OVER up, first_value(l3 IGNORE NULLS) OVER down) AS "AT_TLAG_3hr",
  coalesce(last_value(l6 IGNORE NULLS) OVER up, first_value(l6 IGNORE NULLS) OVER down) AS "AT_TLAG_6hrs"
FROM lagged
WINDOW up AS (PARTITION BY station ORDER BY d, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  down AS (PARTITION BY station ORDER BY d, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
"""


@registered(_WEATHER_LAGS_SQL)
def weather_folder_lags(spark: SparkSession, folder: str) -> DataFrame:
    """A sub-folder of files for each station, the folder run, and its files read back."""
    home = f"{shared_folder(spark).rstrip('/')}/gaugeline-folder-{uuid.uuid4().hex}"
    rows = settle(normalise_weather(raw_weather(spark, folder), keep=["station", "o_orderkey"]))
    write_by_series(rows.withColumnRenamed("station", "series"), f"{home}/in", order_by=N.DATE)
    out = weather_lag_folder(spark, f"{home}/in", f"{home}/out", tiebreak=["o_orderkey"])
    back = spark.read.option("header", True).csv(out)
    lagged = list(N.WEATHER_LAG_HOURS)
    return snake(with_numbers(back, [N.AIR_TEMP, *lagged]).select(
        F.col("o_orderkey").cast("double").cast("bigint").alias("o_orderkey"),
        F.col("series").alias("station"),
        timestamp(back, N.DATE).alias(N.DATE), N.AIR_TEMP, *lagged))


@registered(_WEATHER_LAGS_SQL.replace("a.air, b1", "a.air, a.rh, b1").replace(
    "d, air,", "d, air, CASE WHEN station >= '3' THEN rh END AS rh,"))
def weather_folder_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Files of two headers in one folder: other orders, a column more, a column less."""
    home = f"{shared_folder(spark).rstrip('/')}/gaugeline-headers-{uuid.uuid4().hex}"
    rows = settle(normalise_weather(raw_weather(spark, folder), keep=["station", "o_orderkey"]))
    rows = rows.withColumnRenamed("station", "series")
    early = rows.where("series < '3'").drop(N.HUMIDITY)
    early = early.select(*reversed([ref(c) for c in early.columns])).withColumn("remark", F.lit("none"))
    write_by_series(early, f"{home}/in/early", order_by=N.DATE)
    write_by_series(rows.where("series >= '3'"), f"{home}/in/late", order_by=N.DATE)
    back = spark.read.option("header", True).csv(
        weather_lag_folder(spark, f"{home}/in", f"{home}/out", tiebreak=["o_orderkey"]))
    lagged = list(N.WEATHER_LAG_HOURS)
    return snake(with_numbers(back, [N.AIR_TEMP, N.HUMIDITY, *lagged]).select(
        F.col("o_orderkey").cast("double").cast("bigint").alias("o_orderkey"),
        F.col("series").alias("station"), timestamp(back, N.DATE).alias(N.DATE), N.AIR_TEMP,
        ref(N.HUMIDITY).alias("rh"), *lagged))


@registered(_WEATHER_LAGS_SQL)
def weather_lags_filled(spark: SparkSession, folder: str) -> DataFrame:
    parsed = normalise_weather(raw_weather(spark, folder), keep=["station", "o_orderkey"])
    out = add_weather_lags(
        parsed, keys=["station"], tiebreak=["o_orderkey"], bucket="365 days"
    )
    return snake(out.drop(N.HUMIDITY, N.PRESSURE, N.HOUR))


# ---------------------------------------------------------------- transitions and runs

_CHANGED_SQL = f"""
WITH {LAKE_SQL}, changed AS (
  SELECT *, coalesce(coalesce(flag, 0) <> lag(coalesce(flag, 0)) OVER (
    PARTITION BY site ORDER BY d, event_id), false) AS transition FROM lake)
"""


@registered(_CHANGED_SQL + "SELECT event_id, transition FROM changed")
def transitions(spark: SparkSession, folder: str) -> DataFrame:
    rows = sequence.mark_transitions(lake(spark, folder), N.FLAG, **_SITE)
    return rows.select("event_id", "transition")


@registered(_CHANGED_SQL + """
SELECT event_id FROM changed c WHERE EXISTS (SELECT 1 FROM changed t WHERE t.transition
  AND t.site = c.site AND c.d BETWEEN t.d - INTERVAL 12 HOUR AND t.d + INTERVAL 12 HOUR)
""")
def near_transitions(spark: SparkSession, folder: str) -> DataFrame:
    marked = sequence.mark_transitions(lake(spark, folder), N.FLAG, **_SITE)
    return near_events(marked, "transition", **_SITE).select("event_id")


@registered(f"""
WITH {LAKE_SQL}, readings AS (SELECT event_id, d, flag FROM lake),
changed AS (
  SELECT *, coalesce(coalesce(flag, 0) <> lag(coalesce(flag, 0)) OVER (ORDER BY d, event_id), false)
    AS transition FROM readings),
bounds AS (
  SELECT d, flag, event_id,
    max(CASE WHEN transition THEN d END) OVER (ORDER BY d, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
    min(CASE WHEN transition THEN d END) OVER (ORDER BY d, event_id
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM changed),
near AS (SELECT * FROM bounds
  WHERE d - before <= INTERVAL 12 HOUR OR after - d <= INTERVAL 12 HOUR)
SELECT l.event_id, l.site, l.d, l.lvl, n.flag, l.lvl * 2 AS "DO_1h"
FROM lake l JOIN near n ON l.d = n.d
""")
def transition_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The whole table as one series; features and readings are two views of it."""
    rows = lake(spark, folder)
    features = rows.select(
        "event_id", "site", N.DATE, N.LEVEL,
        *[(F.col(N.LEVEL) * h).alias(f"DO_delta_{h}h") for h in (1, 3)],
        *[(F.col(N.LEVEL) * (h + 1)).alias(f"DO_{h}h") for h in (1, 3)],
    )
    out = transition_table(
        reorder(features, [N.DATE, N.LEVEL]), rows.select("event_id", N.DATE, N.FLAG),
        tiebreak=["event_id"],
    )
    return snake(out)


@registered(f"""
WITH {LAKE_SQL}, numbered AS (
  SELECT site, d, coalesce(flag, 0) = 1 AS is_on,
    row_number() OVER (PARTITION BY site ORDER BY d, event_id) - 1 AS i FROM lake),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY site ORDER BY i) AS g
  FROM numbered WHERE is_on)
SELECT site, min(i) AS start, max(i) + 1 AS "end", count(*) AS length, min(d) AS start_ts,
  max(d) AS end_ts FROM islands GROUP BY site, g
""")
def true_runs(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.true_runs(lake(spark, folder), N.FLAG, **_SITE)


@registered(f"""
WITH {LINES_SQL}, numbered AS (
  SELECT d, flag = 1 AS is_on,
    row_number() OVER (ORDER BY d, l_orderkey, l_linenumber, l_suppkey, price) - 1 AS i FROM lines),
islands AS (SELECT *, i - row_number() OVER (ORDER BY i) AS g FROM numbered WHERE is_on)
SELECT min(i) AS start, max(i) + 1 AS "end", count(*) AS length, min(d) AS start_ts,
  max(d) AS end_ts FROM islands GROUP BY g
""")
def true_runs_global(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.true_runs(
        priced_lines(spark, folder), "flag", ts=N.DATE, bucket="30 days",
        tiebreak=["l_orderkey", "l_linenumber", "l_suppkey", "price"], rows_per_bucket=10_000,
    )


# ---------------------------------------------------------------- coverage and fits


def _coverage_sql(keys: str) -> str:
    key, join = (f"{keys}, ", f"AND h.{keys} = x.{keys}") if keys else ("", "")
    part = f"PARTITION BY {key}day" if keys else "PARTITION BY day"
    using = f"({key}day)"
    return f"""
WITH {LAKE_SQL},
hrs AS (SELECT DISTINCT {key}d::DATE AS day, hour(d) AS h FROM lake),
isl AS (SELECT *, h - row_number() OVER ({part} ORDER BY h) AS g FROM hrs),
runs AS (SELECT {key}day, g, count(*) AS n FROM isl GROUP BY ALL),
streak AS (SELECT {key}day, max(n) AS best FROM runs GROUP BY ALL),
have AS (SELECT {key}day, list(h) AS hs FROM hrs GROUP BY ALL),
base AS (SELECT {key}d::DATE AS day, count(*) AS row_count, min(d) AS first_datetime,
  max(d) AS last_datetime FROM lake GROUP BY ALL)
SELECT {key}day::VARCHAR AS calendar_date, row_count, first_datetime, last_datetime,
  len(hs)::INTEGER AS distinct_hours_with_data, (24 - len(hs))::INTEGER AS hours_missing_in_day,
  array_to_string(list_filter(range(24), lambda x: NOT list_contains(hs, x)), ',')
    AS missing_hours_list,
  best::INTEGER AS longest_consecutive_hour_streak_in_day
FROM base JOIN have USING {using} JOIN streak USING {using}
"""


@registered(_coverage_sql("site"))
def daily_coverage_by_site(spark: SparkSession, folder: str) -> DataFrame:
    return report(daily_coverage(lake(spark, folder), ts=N.DATE, keys=["site"]))


@registered(_coverage_sql(""))
def daily_coverage_global(spark: SparkSession, folder: str) -> DataFrame:
    return report(daily_coverage(lake(spark, folder), ts=N.DATE))


def _blocks_sql(source: str, when: str, keys: str) -> str:
    key = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
WITH days AS (SELECT DISTINCT {key}{when}::DATE AS day FROM {source}),
isl AS (SELECT *, day - row_number() OVER ({part} ORDER BY day)::INTEGER AS g FROM days),
blocks AS (SELECT {key}min(day) AS start_date, max(day) AS end_date FROM isl GROUP BY {key}g)
SELECT {key}row_number() OVER ({part} ORDER BY start_date)::INTEGER AS block_id,
  start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date,
  (end_date - start_date + 1)::INTEGER AS consecutive_calendar_days,
  ((end_date - start_date + 1) // 7)::INTEGER AS whole_weeks_in_block,
  ((end_date - start_date + 1) % 7)::INTEGER AS remainder_days_after_full_weeks,
  (lead(start_date) OVER ({part} ORDER BY start_date) - end_date - 1)::DOUBLE
    AS gap_calendar_days_before_next_block
FROM blocks
"""


@registered(_blocks_sql("events", "ts", "user_id"))
def day_blocks_by_user(spark: SparkSession, folder: str) -> DataFrame:
    days = daily_coverage(table(spark, folder, "events"), ts="ts", keys=["user_id"])
    return report(day_blocks(days, keys=["user_id"]))


@registered(_blocks_sql("orders", "o_orderdate", ""))
def day_blocks_global(spark: SparkSession, folder: str) -> DataFrame:
    days = daily_coverage(table(spark, folder, "orders"), ts="o_orderdate")
    return report(day_blocks(days))


def _fit_sql(keys: str) -> str:
    key = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
WITH {LAKE_SQL},
pts AS (SELECT {key}d::DATE AS day, lvl AS y,
  CASE WHEN lvl IS NOT NULL THEN hour(d) + minute(d) / 60.0 + second(d) / 3600.0 END AS x FROM lake),
fits AS (SELECT {key}day::VARCHAR AS date, count(y) AS n_points,
    CASE WHEN count(y) >= 2 AND min(x) < max(x) THEN regr_slope(y, x) END AS slope,
    CASE WHEN count(y) >= 2 AND min(x) < max(x) THEN regr_intercept(y, x) END AS icept,
    CASE WHEN count(y) >= 2 AND min(x) < max(x) THEN
      CASE WHEN min(y) = max(y) THEN 0 ELSE regr_r2(y, x) END END AS r2,
    min(x) AS t0, max(x) AS t1 FROM pts GROUP BY {key}day),
both_ AS (SELECT * FROM fits UNION ALL BY NAME
  SELECT {key}'MEAN_ACROSS_DAYS' AS date, sum(n_points) AS n_points, avg(slope) AS slope FROM fits {group})
SELECT {key}date, n_points::BIGINT AS n_points, round(slope, 6) AS slope_DO_per_hour,
  round(icept, 6) AS intercept, round(r2, 6) AS r_squared, round(t0, 6) AS time_start_h,
  round(t1, 6) AS time_end_h FROM both_
"""


def _fits(rows: DataFrame, keys: list[str]) -> DataFrame:
    out = append_fit_summary(daily_fit(rows, ts=N.DATE, value=N.LEVEL, keys=keys), keys)
    return rounded(
        out, "slope_DO_per_hour", "intercept", "r_squared", "time_start_h", "time_end_h"
    )


@registered(_fit_sql(""))
def daily_linear_fit(spark: SparkSession, folder: str) -> DataFrame:
    return _fits(lake(spark, folder), [])


@registered(_fit_sql("site"))
def daily_linear_fit_by_site(spark: SparkSession, folder: str) -> DataFrame:
    return _fits(lake(spark, folder), ["site"])


# ---------------------------------------------------------------- yearly weather


def _parsed_weather(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    return normalise_weather(raw_weather(spark, folder), keep=keys)


_BEST_SQL = """
means AS (SELECT {key} year(d) AS y, avg({value}) AS m FROM weather
  WHERE month(d) IN (6, 7, 8) GROUP BY ALL HAVING avg({value}) IS NOT NULL),
best AS (SELECT {key} y FROM means
  QUALIFY row_number() OVER ({part} ORDER BY m DESC, y) = 1)
"""


def _best(value: str, station: bool = False) -> str:
    return _BEST_SQL.format(
        value=value, key="station," if station else "",
        part="PARTITION BY station" if station else "",
    )


@registered(f"""
WITH {WEATHER_SQL} SELECT station, year(d)::INTEGER AS year, round(avg(air), 6) AS summer_mean
FROM weather WHERE month(d) IN (6, 7, 8) GROUP BY ALL HAVING avg(air) IS NOT NULL
""")
def summer_means(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare_parsed(_parsed_weather(spark, folder, ["station"]))
    return rounded(climate.summer_means(rows, N.AIR_TEMP, keys=["station"]), "summer_mean")


@registered(f"WITH {WEATHER_SQL}, {_best('air', True)} SELECT station, y::INTEGER AS best_year FROM best")
def best_summer_years(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepare_parsed(_parsed_weather(spark, folder, ["station"]))
    return climate.best_year(rows, N.AIR_TEMP, keys=["station"])


@registered(f"""
WITH {WEATHER_SQL}, part AS (SELECT * FROM weather WHERE station <> '5-LOW' OR month(d) = 5),
means AS (SELECT station, year(d) AS y, avg(air) AS m FROM part WHERE month(d) IN (6, 7, 8)
  GROUP BY ALL HAVING avg(air) IS NOT NULL),
best AS (SELECT station, y FROM means QUALIFY row_number() OVER (PARTITION BY station ORDER BY m DESC, y) = 1)
SELECT station, y::INTEGER AS best_year FROM (SELECT DISTINCT station FROM part) LEFT JOIN best USING (station)
""")
def best_summer_years_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """One station has readings in May only; it stays, without a year."""
    rows = prepare_parsed(_parsed_weather(spark, folder, ["station"]))
    some = rows.where((F.col("station") != "5-LOW") | (F.month(ref(N.DATE)) == 5))
    return climate.best_year(some, N.AIR_TEMP, keys=["station"])


_YEAR_COLUMNS = """strftime(d, '%Y-%m-%d %H:%M:%S') AS d, air, rh, mb, hour(d)::DOUBLE AS hour"""


@registered(f"WITH {WEATHER_SQL}, {_best('air')} SELECT {_YEAR_COLUMNS} FROM weather, best WHERE year(d) = y")
def hottest_summer(spark: SparkSession, folder: str) -> DataFrame:
    return snake(yearly_analytics(_parsed_weather(spark, folder, []))[N.REPORT_HOTTEST])


@registered(f"""
WITH {WEATHER_SQL}, {_best('rh', True)}
SELECT station, {_YEAR_COLUMNS} FROM weather JOIN best USING (station) WHERE year(d) = y
""")
def humid_summer(spark: SparkSession, folder: str) -> DataFrame:
    parsed = _parsed_weather(spark, folder, ["station"])
    return snake(yearly_analytics(parsed, keys=["station"])[N.REPORT_HUMID])


@registered(f"""
WITH {WEATHER_SQL}
SELECT strftime(make_timestamp(2000, month(d), day(d), hour(d), minute(d), second(d)),
    '%Y-%m-%d %H:%M:%S') AS d,
  round(avg(air), 6) AS air, round(avg(rh), 6) AS rh, round(avg(mb), 6) AS mb,
  hour(d)::DOUBLE AS hour
FROM weather GROUP BY month(d), day(d), hour(d), minute(d), second(d)
""")
def average_year(spark: SparkSession, folder: str) -> DataFrame:
    report = yearly_analytics(_parsed_weather(spark, folder, []))[N.REPORT_AVERAGE]
    return rounded(snake(report), "air", "rh", "mb")


# ---------------------------------------------------------------- whole lake tables

_LAKE_LAGS_SQL = f"""
WITH {LAKE_SQL},
wet AS (SELECT * FROM lake WHERE lvl IS NULL OR lvl <> 0),
gaps AS (SELECT site, (epoch_us(d) - lag(epoch_us(d)) OVER (PARTITION BY site ORDER BY d))
  / 60000000.0 AS g FROM wet),
med AS (SELECT site, quantile_cont(g, 0.5) AS m FROM gaps GROUP BY site),
rolled AS (SELECT *,
  sum(flag) OVER (PARTITION BY site ORDER BY d RANGE BETWEEN INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW) AS s1,
  sum(flag) OVER (PARTITION BY site ORDER BY d RANGE BETWEEN INTERVAL 3 HOUR - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW) AS s3,
  sum(flag) OVER (PARTITION BY site ORDER BY d RANGE BETWEEN INTERVAL 6 HOUR - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW) AS s6
  FROM wet),
lagged AS (
  SELECT r.event_id, r.site, r.d, r.lvl, r.air, r.rh, r.mb, r.flag, hour(r.d)::INTEGER AS hour,
    x1.lvl AS dl1, x3.lvl AS dl3, x6.lvl AS dl6, x1.air AS al1, x3.air AS al3, x6.air AS al6,
    s1 * m AS on1, s3 * m AS on3, s6 * m AS on6
  FROM rolled r JOIN med USING (site)
  JOIN ({_asof('wet', 1, 'site')}) x1 USING (event_id)
  JOIN ({_asof('wet', 3, 'site')}) x3 USING (event_id)
  JOIN ({_asof('wet', 6, 'site')}) x6 USING (event_id)),
full_ AS (SELECT * FROM lagged WHERE dl1 IS NOT NULL AND dl3 IS NOT NULL AND dl6 IS NOT NULL
  AND al1 IS NOT NULL AND al3 IS NOT NULL AND al6 IS NOT NULL
  AND on1 IS NOT NULL AND on3 IS NOT NULL AND on6 IS NOT NULL)
"""
_LAKE_COLUMNS = """f.event_id, f.site, f.d, f.lvl, f.air, f.rh::DOUBLE AS rh, f.mb::DOUBLE AS mb,
  f.flag, f.hour, dl1 AS "DO_TLAG_15", dl3 AS "DO_TLAG_30", dl6 AS "DO_TLAG_60",
  al1 AS "AT_TLAG_15", al3 AS "AT_TLAG_30", al6 AS "AT_TLAG_60",
  round(on1, 6) AS "Aerator_TLAG_15", round(on3, 6) AS "Aerator_TLAG_30",
  round(on6, 6) AS "Aerator_TLAG_60\""""
_LAKE_FUTURES = ", ".join(
    f'round(z{h}.lvl - f.lvl, 6) AS "DO_delta_{h}h", z{h}.lvl AS "DO_{h}h"' for h in N.HORIZONS
)
_LAKE_JOINS = " ".join(
    f"JOIN ({_asof('full_', h, 'site', True)}) z{h} USING (event_id)" for h in N.HORIZONS
)
_ON_COLUMNS = [N.FLAG_LAG_PREFIX + s for s in N.LAKE_LAG_HOURS]


@registered(f"{_LAKE_LAGS_SQL} SELECT {_LAKE_COLUMNS}, {_LAKE_FUTURES} FROM full_ f {_LAKE_JOINS}")
def lake_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    out = lake_features(
        lake(spark, folder), keys=["site"], tiebreak=["event_id"], bucket="30 days"
    )
    return rounded(snake(out), *_ON_COLUMNS, *[f"{N.DELTA_PREFIX}{h}h" for h in N.HORIZONS])


@registered(f"{_LAKE_LAGS_SQL} SELECT {_LAKE_COLUMNS} FROM full_ f")
def lake_lags_only(spark: SparkSession, folder: str) -> DataFrame:
    out = lake_lag_table(
        lake(spark, folder), keys=["site"], tiebreak=["event_id"], bucket="30 days"
    )
    return rounded(snake(out), *_ON_COLUMNS)


@registered(f"""
WITH {WEATHER_SQL}, {{best}}
SELECT '{N.REPORT_HOTTEST}' AS report, count(*) AS rows FROM weather, best WHERE year(d) = y
UNION ALL SELECT '{N.REPORT_HUMID}', count(*) FROM weather, best2 WHERE year(d) = y
UNION ALL SELECT '{N.REPORT_AVERAGE}', count(DISTINCT strftime(d, '%m-%d %H:%M:%S')) FROM weather
""".replace("{best}", _best("air") + ", " + _best("rh").replace("means", "means2").replace("best", "best2")))
def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """The three yearly reports as files, each read back and counted."""
    home = f"{shared_folder(spark).rstrip('/')}/gaugeline-reports-{uuid.uuid4().hex}"
    reports = yearly_analytics(settle(_parsed_weather(spark, folder, [])))
    counted = None
    for name, path in write_reports(reports, home, order_by=N.DATE).items():
        own = read_table(spark, path).agg(F.count(F.lit(1)).alias("rows")).withColumn("report", F.lit(name))
        counted = own if counted is None else counted.unionByName(own)
    return counted


_LAKE_TARGETS = [N.LEVEL, *[f"{N.DELTA_PREFIX}{h}h" for h in N.HORIZONS], *[f"DO_{h}h" for h in N.HORIZONS]]


@registered(f"""
{_LAKE_LAGS_SQL}, t AS (SELECT f.lvl AS "DO", {_LAKE_FUTURES} FROM full_ f {_LAKE_JOINS})
""" + " UNION ALL ".join(
    f"""SELECT '{t}' AS target, 'pred_{t}_quantile_mid' AS prediction, count("{t}") AS n_values FROM t"""
    for t in _LAKE_TARGETS))
def file_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table as a file under its usual name: what its header offers for training."""
    home = f"{shared_folder(spark).rstrip('/')}/gaugeline-targets-{uuid.uuid4().hex}"
    features = lake_features(
        lake(spark, folder), keys=["site"], tiebreak=["event_id"], bucket="30 days")
    path = write_table(features, default_output(f"{home}/lake.csv", N.LAKE_SUFFIX))
    found = peek_targets(spark, path)
    table_ = read_table(spark, path)
    counts = table_.agg(*[F.count(number(table_, t)).alias(t) for t in found])
    cells = F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(prediction_column(t, "mid")).alias("prediction"),
                 ref(t).alias("n_values")) for t in found])
    return counts.select(F.inline(cells))


# ---------------------------------------------------------------- splits, medians, errors


def _split_sql(source: str) -> str:
    return f"""
WITH {LAKE_SQL}, src AS ({source}),
weeks AS (SELECT DISTINCT date_trunc('week', d) AS w FROM src),
ranked AS (SELECT w, row_number() OVER (ORDER BY w) AS r, count(*) OVER () AS n FROM weeks),
sized AS (SELECT *, greatest(1, ceil(n * 0.3::DOUBLE))::INTEGER AS nt FROM ranked),
parts AS (SELECT w, CASE WHEN r > n - nt THEN 'test'
  WHEN r > n - nt - greatest(1, ceil((n - nt) * 0.2::DOUBLE)) THEN 'val' ELSE 'fit' END AS split
  FROM sized)
SELECT split, count(*) AS rows FROM src JOIN parts ON date_trunc('week', d) = w GROUP BY split
"""


@registered(_split_sql("SELECT d FROM lake"))
def week_split_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = lake(spark, folder).select("event_id", N.DATE)
    return split_counts(nested_holdout(rows, ts=N.DATE, tiebreak=["event_id"]))


@registered(f"""
WITH {LAKE_SQL}, weeks AS (SELECT DISTINCT date_trunc('week', d) AS w FROM lake),
ranked AS (SELECT w, row_number() OVER (ORDER BY w) AS r, count(*) OVER () AS n FROM weeks)
SELECT event_id, CASE WHEN r > n - greatest(1, ceil(n * 0.3::DOUBLE)) THEN 'test' ELSE 'train' END
  AS split FROM lake JOIN ranked ON date_trunc('week', d) = w
""")
def week_holdout(spark: SparkSession, folder: str) -> DataFrame:
    rows = lake(spark, folder).select("event_id", N.DATE)
    return holdout(rows, ts=N.DATE, tiebreak=["event_id"]).select("event_id", "split")


@registered(f"""
WITH {LAKE_SQL}, src AS (SELECT event_id,
  TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(d) - epoch_us(TIMESTAMP '2024-01-01')) // 4) AS t
  FROM lake),
numbered AS (SELECT event_id, row_number() OVER (ORDER BY t, event_id) - 1 AS i, count(*) OVER () AS n
  FROM src),
cuts AS (SELECT *, floor(n * (1.0::DOUBLE - 0.3::DOUBLE))::BIGINT AS k FROM numbered)
SELECT event_id, CASE WHEN i >= k THEN 'test'
  WHEN i >= floor(k * (1.0::DOUBLE - 0.2::DOUBLE))::BIGINT THEN 'val' ELSE 'fit' END AS split FROM cuts
""")
def row_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """The month squeezed into a week and a half, so that the split goes by rows."""
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    micros = F.unix_micros(F.col(N.DATE).cast("timestamp")) - F.unix_micros(day.cast("timestamp"))
    quarter = F.call_function("div", micros, F.lit(4))
    squeezed = lake(spark, folder).select(
        "event_id",
        (day + F.make_dt_interval(secs=(quarter / F.lit(1_000_000)).cast("decimal(18,6)")))
        .alias(N.DATE),
    )
    return nested_holdout(
        squeezed, ts=N.DATE, tiebreak=["event_id"], bucket="1 hour"
    ).select("event_id", "split")


@registered(f"""
WITH {LAKE_SQL}, weeks AS (SELECT DISTINCT date_trunc('week', d) AS w FROM lake),
ranked AS (SELECT w, row_number() OVER (ORDER BY w) AS r, count(*) OVER () AS n FROM weeks),
sized AS (SELECT *, greatest(1, ceil(n * 0.3::DOUBLE))::INTEGER AS nt FROM ranked),
fit AS (SELECT w FROM sized WHERE r <= n - nt - greatest(1, ceil((n - nt) * 0.2::DOUBLE)))
SELECT round(quantile_cont(air, 0.5), 6) AS air, round(quantile_cont(rh::DOUBLE, 0.5), 6) AS rh,
  round(quantile_cont(mb::DOUBLE, 0.5), 6) AS mb, round(quantile_cont(lvl, 0.5), 6) AS lvl
FROM lake JOIN fit ON date_trunc('week', d) = w
""")
def fit_medians(spark: SparkSession, folder: str) -> DataFrame:
    rows = typed_lake(spark, folder)
    fit = nested_holdout(rows, ts=N.DATE, tiebreak=["event_id"]).where(F.col("split") == "fit")
    columns = [N.AIR_TEMP, N.HUMIDITY, N.PRESSURE, N.LEVEL]
    return rounded(snake(exact_medians(fit, {c: c for c in columns})), "air", "rh", "mb", "lvl")


@registered(f"""
WITH {LAKE_SQL}, x AS ({_asof('lake', 1, 'site')})
SELECT site, round(avg(abs(l.lvl - x.lvl)), 6) AS mae FROM lake l JOIN x USING (event_id) GROUP BY site
""")
def persistence_error(spark: SparkSession, folder: str) -> DataFrame:
    """Mean absolute error, for each site, of taking the level of an hour ago."""
    rows = lags.add_time_lags(lake(spark, folder), {"guess": (N.LEVEL, 1)}, **_SITE)
    return rounded(mean_absolute_error(rows, N.LEVEL, "guess", by=["site"]), "mae")


@registered(f"""
WITH {LAKE_SQL}, x AS ({_asof('lake', 1, 'site')})
SELECT site, round(avg(abs(l.lvl - x.lvl)), 6) AS mae FROM lake l JOIN x USING (event_id) GROUP BY site
""")
def metrics_file(spark: SparkSession, folder: str) -> DataFrame:
    """The errors of each site as a metrics file, read back."""
    path = f"{shared_folder(spark).rstrip('/')}/gaugeline-metrics-{uuid.uuid4().hex}"
    write_metrics(persistence_error(spark, folder), path)
    return spark.read.schema("site bigint, mae double").json(path)


_COMPLETE = "lvl IS NOT NULL AND air IS NOT NULL AND rh IS NOT NULL AND mb IS NOT NULL"


@registered(_split_sql(f"SELECT d FROM lake WHERE {_COMPLETE}"))
def complete_rows_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with the target and all features, dealt to fit, validation and test."""
    rows = training_table(
        lake(spark, folder), N.LEVEL, [N.AIR_TEMP, N.HUMIDITY, N.PRESSURE], ts=N.DATE,
        tiebreak=["event_id"], require_features=True)
    return split_counts(rows)


# ---------------------------------------------------------------- pairing


@registered("SELECT event_id, ts, value AS change, value * 2 AS level FROM events")
def paired_predictions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    return pair_predictions(
        rows.select("event_id", "ts", F.col("value").alias("change")),
        rows.select("event_id", "ts", (F.col("value") * 2).alias("level")),
        ["level"], ts="ts", keys=["event_id"],
    )


@registered("""
SELECT o_orderkey, date_trunc('hour', o_orderdate + to_minutes((o_orderkey % 1440)::INTEGER)) AS d,
  o_totalprice AS change, o_totalprice * 2 AS level FROM orders
""")
def paired_repeated_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times cut to the hour, which many rows of a station share; they pair in order."""
    minutes = F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("station"),
        F.date_trunc("hour", F.col("o_orderdate") + minutes).cast("timestamp_ntz").alias("d"),
        F.col("o_totalprice").alias("change"),
    )
    levels = rows.select("station", "d", "o_orderkey", (F.col("change") * 2).alias("level"))
    paired = pair_predictions(
        rows, levels, ["level"], ts="d", keys=["station"], tiebreak=["o_orderkey"])
    return paired.drop("station")


# ---------------------------------------------------------------- scoring with a given model


def _given(target: str, label: str, shift: float) -> QuantileModel:
    """Two trees on the weather and the day, small enough to be said in SQL."""
    leaf = lambda value: Node(-1, 0.0, -1, -1, value)
    weather = [Node(0, 20.0, 1, 4, 0.0), Node(1, 60.0, 2, 3, 0.0), leaf(0.5), leaf(1.0), leaf(-0.25)]
    day = [Node(2, 190.0, 1, 2, 0.0), leaf(0.125), leaf(0.25)]
    return QuantileModel(
        target, [N.AIR_TEMP, N.HUMIDITY, "dayofyear"],
        {N.AIR_TEMP: 12.0, N.HUMIDITY: 50.0, "dayofyear": 1.0}, shift, [weather, day],
        N.QUANTILE_TIERS[label], label, "pure_weather",
    )


def _given_sql(shift: float) -> str:
    return f"""{shift} + CASE WHEN coalesce(air, 12) <= 20 THEN
    CASE WHEN coalesce(rh, 50) <= 60 THEN 0.5 ELSE 1.0 END ELSE -0.25 END
  + CASE WHEN dayofyear(d) <= 190 THEN 0.125 ELSE 0.25 END"""


@registered(f"""
WITH {LAKE_SQL} SELECT event_id, round(({_given_sql(1.5)})::DOUBLE, 6) AS "pred_DO_quantile_high" FROM lake
""")
def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A saved model, read back from the registry, scores every reading; marks take the median."""
    models = f"{shared_folder(spark)}/gaugeline-models-{uuid.uuid4().hex}"
    name = save_model(spark, _given(N.LEVEL, "high", 1.5), models)
    scored = score(lake(spark, folder), load_model(spark, models, name))
    return rounded(scored.select("event_id", "pred_DO_quantile_high"), "pred_DO_quantile_high")


@registered(f"""
WITH {WEATHER_SQL}
SELECT o_orderkey, station, round(({_given_sql(-0.5)})::DOUBLE, 6) AS "pred_DO_delta_1h_quantile_mid",
  round(({_given_sql(4.0)})::DOUBLE, 6) AS "pred_DO_1h_quantile_mid" FROM weather
""")
def scenario_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Stations as scenarios: a change model and a level model score the same weather rows."""
    rows = normalise_weather(raw_weather(spark, folder), keep=["station", "o_orderkey"])
    models = [_given(f"{N.DELTA_PREFIX}1h", "mid", -0.5), _given("DO_1h", "mid", 4.0)]
    columns = ["pred_DO_delta_1h_quantile_mid", "pred_DO_1h_quantile_mid"]
    return rounded(score_all(rows, models).select("o_orderkey", "station", *columns), *columns)


# ---------------------------------------------------------------- models (no SQL form)

def _training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Written once, since training and scoring both read them."""
    return settle(lake_features(
        lake(spark, folder), keys=["site"], tiebreak=["event_id"], bucket="30 days"
    ))


@registered()
def quantile_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A model of the upper quantile, kept in the registry, scores every row."""
    rows = _training_rows(spark, folder)
    folder_ = f"{shared_folder(spark)}/gaugeline-models-{uuid.uuid4().hex}"
    model = train_quantile(rows, N.LEVEL, "high", tiebreak=["event_id"])
    name = save_model(spark, model, folder_)
    return snake(score(rows, load_model(spark, folder_, name)))


@registered()
def quantile_bands(spark: SparkSession, folder: str) -> DataFrame:
    """All three quantiles from one training, in order on every row."""
    rows = _training_rows(spark, folder)
    models = train_tiers(rows, N.LEVEL, tiebreak=["event_id"], shared=True)
    names = [f"pred_DO_quantile_{t}" for t in models]
    return rounded(score_tiers(rows, models).select("event_id", *names), *names)


@registered()
def model_report(spark: SparkSession, folder: str) -> DataFrame:
    """All eleven targets, on the operator's own schedule."""
    rows = _training_rows(spark, folder)
    models, failures = train_targets(rows, tiebreak=["event_id"])
    return metrics_report(spark, models, failures)


@registered()
def model_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = _training_rows(spark, folder)
    folder_ = f"{shared_folder(spark)}/gaugeline-models-{uuid.uuid4().hex}"
    model = train_quantile(rows, N.LEVEL, "low", tiebreak=["event_id"])
    save_model(spark, model, folder_)
    save_model(spark, model, folder_, "superseded")
    delete_model(spark, folder_, "superseded")
    return list_models(spark, folder_).drop("saved_at")
