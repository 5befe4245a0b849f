"""The weather normalisation on files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gaugeline.plans.weather import normalise_weather


def read_weather_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Raw weather CSV files landing in `folder`, as text columns of the given schema."""
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def write_normalised(
    raw: DataFrame, out: str, checkpoint: str, *, once: bool = False
) -> StreamingQuery:
    """Append the normalised rows as Parquet; with `once`, stop when the present files are done."""
    writer = (
        normalise_weather(raw).writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
