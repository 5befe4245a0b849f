"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gaugeline.queries.catalog import QUERIES
from gaugeline.session import get_session

HEADLINE = (
    "daily_linear_fit", "daily_coverage_by_site", "day_blocks_by_user", "weather_normalised",
    "average_year", "hottest_summer", "lag_features", "lag_features_global", "future_deltas",
    "minutes_on", "supplier_price_lags", "spacing_medians", "near_transitions", "true_runs",
    "weather_lags_filled", "lake_feature_table", "week_split_counts", "fit_medians",
    "quantile_scores",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/events.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
