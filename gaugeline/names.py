"""Column names, aliases and constants shared by the operators."""

from __future__ import annotations

# Header names, aliases and constants that input files, models and reports rely on.
DATE = "DATE"
LEVEL = "DO"
AIR_TEMP = "Air temp C"
HUMIDITY = "Relative Humidity (%)"
PRESSURE = "Atmospheric Pressure (mb)"
HOUR = "hour"
FLAG = "Aerated (1/0)"
FLAG_HINT = "aerat"

WEATHER_ALIASES = {
    DATE: ("valid", "date"),
    AIR_TEMP: ("tmpc", "air temp c"),
    HUMIDITY: ("relh", "relative humidity (%)"),
    PRESSURE: ("mslp", "atmospheric pressure (mb)"),
}

LAKE_LAG_HOURS = {"15": 1, "30": 3, "60": 6}
LEVEL_LAG_PREFIX = "DO_TLAG_"
AIR_LAG_PREFIX = "AT_TLAG_"
FLAG_LAG_PREFIX = "Aerator_TLAG_"
WEATHER_LAG_HOURS = {"AT_TLAG_1hr": 1, "AT_TLAG_3hr": 3, "AT_TLAG_6hrs": 6}

HORIZONS = (1, 3, 6, 12, 24)
DELTA_PREFIX = "DO_delta_"
FUTURE_LEVEL_PATTERN = r"DO_\d+h"

SEASON_MONTHS = (5, 9)
SUMMER_MONTHS = (6, 7, 8)
REFERENCE_YEAR = 2000
DATE_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"
SUMMARY_LABEL = "MEAN_ACROSS_DAYS"

TRANSITION_REACH_HOURS = 12

CALENDAR_FEATURES = ("year", "month", "day", "dayofyear")
WEATHER_FEATURES = (AIR_TEMP, HUMIDITY, PRESSURE, HOUR)
AIR_LAG_GROUPS = (
    ("AT_TLAG_1hr", "AT_TLAG_3hr", "AT_TLAG_6hrs"),
    ("AT_TLAG_15", "AT_TLAG_30", "AT_TLAG_60"),
)

QUANTILE_TIERS = {"low": 0.1, "mid": 0.5, "high": 0.9}
TEST_RATIO = 0.30
VALIDATION_RATIO = 0.20
MIN_WEEKS = 3
BOOST_ROUNDS = 300
LEARNING_RATE = 0.05
TREE_LEAVES = 31
FEATURE_FRACTION = 0.9
SEED = 42
PATIENCE = 50

LAKE_SUFFIX = "_parsed_DOdeltas"
PARSED_SUFFIX = "_parsed"
REPORT_HOTTEST = "Largest_Temp_Summer"
REPORT_HUMID = "Largest_Humidity_Summer"
REPORT_AVERAGE = "Average_Year"
