"""Published readings and the line fits published for them."""

from datetime import datetime, timedelta

import pytest

from gaugeline import names as N
from gaugeline.plans.reports import daily_fit_report

# Half-hourly levels from a first time, and the published fit of the day as
# (points, slope, intercept, r squared, first hour, last hour).
DAYS = {
    "2025-10-02": (
        "15:00",
        [0.41, 0.68, 1.35, 2.99, 3.29, 2.88, 3.07, 3.21, 3.4, 3.32, 3.09, 2.97, 3.34, 1.84, 2.39],
        (15, 0.22357142857142853, -1.5874047619047604, 0.24974657147506954, 15.0, 22.0),
    ),
    "2025-10-09": ("13:30", [1.91, 2.23], (2, 0.64, -6.73, 1.0, 13.5, 14.0)),
    "2025-10-15": (
        "00:00",
        [5.15, 5.25, 5.32, 4.94, 4.72, 4.93, 4.91, 4.83, 4.84, 4.86, 4.75, 4.49],
        (12, -0.10608391608391608, 5.207564102564103, 0.6772073643207446, 0.0, 5.5),
    ),
    "2025-10-16": (
        "13:30",
        [3.15, 2.9, 3.34, 3.64, 4.76, 4.78, 5.09, 4.99, 4.93, 4.74, 5.0, 4.71, 4.84, 4.77, 5.11,
         4.97, 5.46, 5.36, 5.22, 5.5, 5.22],
        (21, 0.1962077922077922, 1.0596796536796536, 0.6464554541768898, 13.5, 23.5),
    ),
}


def test_daily_fits(spark):
    readings = []
    for day, (first, levels, _) in DAYS.items():
        start = datetime.fromisoformat(f"{day} {first}")
        for i, level in enumerate(levels):
            when = start + timedelta(minutes=30 * i)
            text = f"{when.month}/{when.day}/{when:%y} {when.hour}:{when:%M}"
            readings.append((text, str(level)))
    df = spark.createDataFrame(readings, "DATE string, DO string")
    got = {r["date"]: tuple(r)[1:] for r in daily_fit_report(df).collect()}
    for day, (_, _, fit) in DAYS.items():
        assert got[day] == pytest.approx(fit, rel=1e-12)
    points, slope = got[N.SUMMARY_LABEL][:2]
    assert points == sum(f[0] for _, _, f in DAYS.values())
    assert slope == pytest.approx(sum(f[1] for _, _, f in DAYS.values()) / 4, rel=1e-12)
