"""Whole runs from input files to output files.

Dates are read by the layouts that the whole column shows (`functions/dates.py`), which is one pass over
the text before the run; the plans themselves go row by row and take columns that are times already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gaugeline import names as N
from gaugeline.functions.columns import date_column, prediction_column
from gaugeline.functions.dates import with_dates
from gaugeline.functions.values import with_numbers
from gaugeline.operators.boosting import QuantileModel, train_quantile, train_targets
from gaugeline.operators.coverage import day_blocks
from gaugeline.operators.scoring import metrics_record, metrics_report, score
from gaugeline.plans.lake import lake_features, lake_lag_table
from gaugeline.plans.reports import coverage_report, daily_fit_report, transition_table
from gaugeline.plans.weather import (
    add_weather_lags, normalise_weather, prepare_parsed, yearly_analytics,
)
from gaugeline.session import settle
from gaugeline.sources.registry import load_model, save_model
from gaugeline.sources.tables import (
    default_output, read_series_folder, read_table, write_by_series, write_metrics, write_reports,
    write_table,
)


def _read(spark: SparkSession, source: str, date: str | None = None) -> DataFrame:
    """A table whose date column (`functions.columns.date_column`) is a time."""
    df = read_table(spark, source)
    return with_dates(df, date_column(df.columns, date))


def _beside(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0] or "."


def lake_file(
    spark: SparkSession, source: str, out: str | None = None, *,
    horizons: Sequence[int] | None = N.HORIZONS, **options,
) -> str:
    """Lake readings to features, with future levels unless `horizons` is None."""
    df = _read(spark, source, options.get("date"))
    options = {"bucket": "auto"} | options
    if horizons is None:
        table, suffix = lake_lag_table(df, **options), N.PARSED_SUFFIX
    else:
        table, suffix = lake_features(df, horizons, **options), N.LAKE_SUFFIX
    ts = date_column(table.columns, options.get("date"))
    return write_table(table, out or default_output(source, suffix), source, order_by=ts)


def weather_file(spark: SparkSession, source: str, out: str | None = None) -> str:
    """Raw weather to a parsed table."""
    raw = read_table(spark, source)
    date = next((c for c in raw.columns if c.lower() in N.WEATHER_ALIASES[N.DATE]), None)
    table = normalise_weather(with_dates(raw, date) if date else raw)
    return write_table(table, out or default_output(source, N.PARSED_SUFFIX), source)


def yearly_files(spark: SparkSession, source: str, folder: str | None = None) -> dict[str, str]:
    """Parsed weather to the three yearly reports, from one reading of the text."""
    table = settle(prepare_parsed(_read(spark, source, N.DATE)))
    return write_reports(
        yearly_analytics(table), folder or _beside(source), source, order_by=N.DATE
    )


def coverage_files(spark: SparkSession, source: str, folder: str) -> dict[str, str]:
    """Daily coverage and day blocks; both come from one pass over the readings."""
    days = settle(coverage_report(_read(spark, source))["daily_time_coverage"])
    tables = {
        "daily_time_coverage": (days, "calendar_date"),
        "consecutive_day_blocks": (day_blocks(days), "block_id"),
    }
    return {
        name: write_table(table, f"{folder.rstrip('/')}/{name}", source, order_by=by)
        for name, (table, by) in tables.items()
    }


def daily_fit_file(spark: SparkSession, source: str, out: str) -> str:
    return write_table(daily_fit_report(_read(spark, source)), out, source, order_by="date")


def weather_lag_folder(
    spark: SparkSession, folder: str, out: str, bucket: str | int = "auto",
    tiebreak: Sequence[str] = (),
) -> str:
    """Air-temperature lags for every file of a folder, each file a series of its own, read by its
    own header.

    `tiebreak` names columns, read as numbers, that order rows of equal time.
    """
    table = with_numbers(read_series_folder(spark, folder, mixed=True), tiebreak)
    table = with_dates(table, N.DATE) if N.DATE in table.columns else table
    lagged = add_weather_lags(table, keys=["series"], tiebreak=tiebreak, bucket=bucket)
    return write_by_series(lagged, out, order_by=N.DATE)


def transition_file(
    spark: SparkSession, features: str, readings: str, out: str,
    bucket: str | int = "auto",
) -> str:
    table = transition_table(
        _read(spark, features), _read(spark, readings), bucket=bucket
    )
    return write_table(table, out, features)


def train_file(
    spark: SparkSession, source: str, target: str, registry: str, tier: str = "mid",
    name: str | None = None, **options,
) -> tuple[str, QuantileModel]:
    """Train on a feature table and save the model; returns its name and the model."""
    df = _read(spark, source)
    model = train_quantile(df, target, tier, ts=date_column(df.columns), **options)
    return save_model(spark, model, registry, name), model


def train_all_file(
    spark: SparkSession, source: str, registry: str, metrics: str,
    wanted: Sequence[str] | None = None, **options,
) -> DataFrame:
    """Train every target, save the models and write the record of the run; returns the report."""
    table = settle(_read(spark, source, N.DATE))
    models, failures = train_targets(table, wanted, **options)
    paths = {}
    for model in models:
        name = f"model_weather_only_{model.target}_{model.label}"
        paths[model.target] = f"{registry.rstrip('/')}/{save_model(spark, model, registry, name)}"
    write_metrics(metrics_record(spark, models, source, paths), metrics)
    return metrics_report(spark, models, failures)


def predict_file(
    spark: SparkSession, registry: str, name: str, source: str, out: str,
    weather_only: bool = False,
) -> tuple[str, str]:
    """Score a table with a saved model; returns the path and the name of the new column."""
    model = load_model(spark, registry, name)
    table = score(read_table(spark, source), model, weather_only=weather_only)
    column = prediction_column(model.target, model.label, weather_only)
    return write_table(table, out, source), column
