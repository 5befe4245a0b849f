"""The given tables seen as lake readings, weather and scenarios. Whole tables, every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline import names as N


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lake(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as readings of one sensor per user. The air temperature is text with an "M" mark."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("site"),
        F.col("ts").alias(N.DATE),
        F.when(kind == "signup", F.lit(None)).when(value < 1, F.lit(0.0)).otherwise(value)
        .alias(N.LEVEL),
        F.when(k < 5, F.lit("M")).otherwise(k.cast("string")).alias(N.AIR_TEMP),
        (F.lit(35.5) + F.col("event_id") % 50).alias(N.HUMIDITY),
        (F.lit(1000.0) + F.col("user_id") % 30).alias(N.PRESSURE),
        F.when(kind == "signup", F.lit(None))
        .otherwise(kind.isin("error", "click").cast("double")).alias(N.FLAG),
    )


LAKE_SQL = """
lake AS (
  SELECT event_id, user_id AS site, ts AS d,
    CASE WHEN event_type = 'signup' THEN NULL WHEN value < 1 THEN 0.0 ELSE value END AS lvl,
    CASE WHEN regexp_extract(props, '([0-9]+)', 1)::DOUBLE < 5 THEN NULL
      ELSE regexp_extract(props, '([0-9]+)', 1)::DOUBLE END AS air,
    35.5 + event_id % 50 AS rh, 1000.0 + user_id % 30 AS mb,
    CASE WHEN event_type = 'signup' THEN NULL
      WHEN event_type IN ('error', 'click') THEN 1.0 ELSE 0.0 END::DOUBLE AS flag
  FROM events)
"""


def raw_weather(spark: SparkSession, folder: str) -> DataFrame:
    """`orders` as raw station reports in text, one station per order priority."""
    minutes = F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("station"),
        F.date_format(F.col("o_orderdate") + minutes, "yyyy-MM-dd HH:mm").alias(" Valid"),
        F.when(price < 20000, F.lit("M"))
        .otherwise((F.floor(price / 100) / 100).cast("string")).alias("tmpc"),
        F.when(price > 480000, F.lit("NaN"))
        .otherwise((F.col("o_custkey") % 101).cast("string")).alias("RELH"),
        F.when(F.col("o_custkey") % 11 == 0, F.lit("M"))
        .when(F.col("o_custkey") % 13 == 0, F.lit(""))
        .otherwise((F.lit(990) + F.col("o_custkey") % 40).cast("string")).alias("mslp"),
        F.col("o_orderstatus").alias("remark"),
    )


WEATHER_SQL = """
raw_weather AS (
  SELECT o_orderkey, o_orderpriority AS station,
    o_orderdate + to_minutes((o_orderkey % 1440)::INTEGER) AS d,
    CASE WHEN o_totalprice >= 20000 THEN floor(o_totalprice / 100) / 100 END AS air,
    CASE WHEN o_totalprice <= 480000 THEN (o_custkey % 101)::DOUBLE END AS rh,
    CASE WHEN o_custkey % 11 = 0 THEN 'M' WHEN o_custkey % 13 = 0 THEN ''
      ELSE (990 + o_custkey % 40)::VARCHAR END AS mb
  FROM orders),
weather AS (
  SELECT o_orderkey, station,
    date_trunc('hour', d + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND) AS d,
    air, rh, CASE WHEN mb <> '' THEN mb::DOUBLE END AS mb
  FROM raw_weather WHERE mb <> 'M' AND month(d) BETWEEN 5 AND 9)
"""


def priced_lines(spark: SparkSession, folder: str) -> DataFrame:
    """`lineitem` as one long series of prices for each supplier, many rows at equal times."""
    seconds = F.make_dt_interval(secs=(F.col("l_orderkey") % 86400).cast("decimal(18,6)"))
    return table(spark, folder, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber",
        (F.col("l_shipdate") + seconds).alias(N.DATE),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_returnflag") == "R").cast("double").alias("flag"),
    )


LINES_SQL = """
lines AS (
  SELECT l_suppkey, l_orderkey, l_linenumber,
    l_shipdate + to_seconds((l_orderkey % 86400)::DOUBLE) AS d, l_extendedprice AS price,
    (l_returnflag = 'R')::INTEGER::DOUBLE AS flag
  FROM lineitem)
"""
