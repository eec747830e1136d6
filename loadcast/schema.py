"""Column names, feature lists and fixed values shared by every module."""

from __future__ import annotations

import datetime

from pyspark.sql import types as T

SERIES = "series_id"
DATE = "date"

# Panel measures (all DoubleType after coercion).
MAX_DEMAND = "max_demand"
GAS_DEMAND = "gas_demand"
SOLAR_MAX = "solar_max"
TEMP_HIGH = "temp_high"
TEMP_AVG = "temp_avg"
TEMP_LOW = "temp_low"
FEELS_LIKE = "feels_like"
NUMERIC_INPUTS = [MAX_DEMAND, GAS_DEMAND, SOLAR_MAX, TEMP_HIGH, TEMP_AVG, TEMP_LOW,
                  FEELS_LIKE]
REQUIRED = [DATE, MAX_DEMAND]
WARNED = [TEMP_HIGH, TEMP_AVG, TEMP_LOW, FEELS_LIKE]
GAS_INPUTS = [GAS_DEMAND, SOLAR_MAX]

# Weekday names, Monday first (weekday() = 0 is Monday).
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
                 "Saturday", "Sunday"]

# Day-type synonyms (compared after trim + lower case).
DAY_TYPE_WEEKDAY_SYNONYMS = ["weekday", "workday", "평일", "근무일"]
DAY_TYPE_HOLIDAY_SYNONYMS = ["holiday", "weekend", "public holiday", "휴일", "주말",
                             "공휴일"]
DAY_TYPE_WEEKDAY = "weekday"
DAY_TYPE_HOLIDAY = "holiday"

# Fixed-date national public holidays of Korea as (month, day).
# Lunar festivals and substitute days follow from functions.lunar.
FIXED_DATE_HOLIDAYS = [
    (1, 1, "New Year's Day"),
    (3, 1, "Independence Movement Day"),
    (5, 5, "Children's Day"),
    (6, 6, "Memorial Day"),
    (8, 15, "Liberation Day"),
    (10, 3, "National Foundation Day"),
    (10, 9, "Hangul Day"),
    (12, 25, "Christmas Day"),
]

# From when on a holiday that falls on a day off is made up for, and which ones are.
SUBSTITUTE_FROM = {"festival": datetime.date(2014, 1, 1), "national": datetime.date(2021, 8, 4), "later": datetime.date(2023, 5, 4)}
SUBSTITUTED_DAYS = {"festival": [(5, 5)], "national": [(3, 1), (8, 15), (10, 3), (10, 9)], "later": [(12, 25)]}

# One-off public holidays (elections and days decided for once).
ONE_OFF_HOLIDAYS = [
    ("2012-04-11", "Election Day"), ("2012-12-19", "Election Day"), ("2014-06-04", "Election Day"),
    ("2015-08-14", "Temporary Holiday"), ("2016-04-13", "Election Day"), ("2016-05-06", "Temporary Holiday"),
    ("2017-05-09", "Election Day"), ("2017-10-02", "Temporary Holiday"), ("2018-06-13", "Election Day"),
    ("2020-04-15", "Election Day"), ("2020-08-17", "Temporary Holiday"), ("2022-03-09", "Election Day"),
    ("2022-06-01", "Election Day"), ("2023-10-02", "Temporary Holiday"), ("2024-04-10", "Election Day"),
    ("2024-10-01", "Temporary Holiday"), ("2025-01-27", "Temporary Holiday"), ("2025-06-03", "Election Day"),
]

# Seasons by month.
SUMMER_MONTHS = [5, 6, 7, 8, 9]
WINTER_MONTHS = [10, 11, 12, 1, 2, 3, 4]
COOLING_BASE = 25.0
HEATING_BASE = 10.0

# Derived feature names.
YEAR, MONTH, DAY = "year", "month", "day"
WEEKDAY_NUM = "weekday_num"
WEEKDAY_NAME = "weekday_name"
IS_HOLIDAY = "is_holiday"
IS_BUSINESS_DAY = "is_business_day"
DAY_TYPE = "day_type"
IS_SUMMER, IS_WINTER = "is_summer", "is_winter"
COOLING = "cooling_intensity"
HEATING = "heating_intensity"
DIURNAL = "diurnal_range"
DEMAND_LAG1 = "demand_lag1"
DEMAND_LAG7 = "demand_lag7"
DEMAND_LAST_YEAR_DOW = "demand_last_year_dow"
RESIDUAL_LOAD = "residual_load"
SOLAR_RATIO = "solar_ratio"
RESIDUAL_RATIO = "residual_ratio"
GAS_BUDGET = "gas_budget"
GAS_LAG1 = "gas_lag1"
GAS_CHANGE_LAG1 = "gas_change_lag1"
DOW_PREFIX = "dow_"
DOW_COLUMNS = [DOW_PREFIX + n.lower() for n in WEEKDAY_NAMES]

LAG_COLUMNS = [DEMAND_LAG1, DEMAND_LAG7, DEMAND_LAST_YEAR_DOW]

# Feature order of the peak-demand model: base list, temperature extras that
# exist in the input, then the weekday one-hots.
DEMAND_BASE_FEATURES = [COOLING, HEATING, MONTH, DEMAND_LAG1, DEMAND_LAG7,
                        DEMAND_LAST_YEAR_DOW, IS_HOLIDAY, IS_BUSINESS_DAY]
DEMAND_TEMP_EXTRAS = [TEMP_HIGH, TEMP_LOW, FEELS_LIKE, DIURNAL]

# Feature order of the gas model.
GAS_FEATURES = [MAX_DEMAND, SOLAR_MAX, RESIDUAL_LOAD, SOLAR_RATIO, RESIDUAL_RATIO,
                GAS_BUDGET, GAS_LAG1, GAS_CHANGE_LAG1, IS_BUSINESS_DAY]

# Monotone direction per gas feature (+1 rising, -1 falling).
GAS_MONOTONE = {
    MAX_DEMAND: 1,
    SOLAR_MAX: -1,
    RESIDUAL_LOAD: 1,
    SOLAR_RATIO: -1,
    RESIDUAL_RATIO: 1,
    GAS_BUDGET: 1,
    GAS_LAG1: 0,
    GAS_CHANGE_LAG1: 0,
}


def demand_features(columns: list[str]) -> list[str]:
    """Ordered feature list of the peak-demand model for a table's columns."""
    extras = [c for c in DEMAND_TEMP_EXTRAS if c in columns]
    dummies = [c for c in DOW_COLUMNS if c in columns]
    return DEMAND_BASE_FEATURES + extras + dummies


def gas_features(columns: list[str]) -> list[str]:
    return [c for c in GAS_FEATURES if c in columns]


RAW_DAILY_SCHEMA = T.StructType([
    T.StructField(SERIES, T.StringType()),
    T.StructField(DATE, T.StringType()),
    T.StructField(MAX_DEMAND, T.StringType()),
    T.StructField(TEMP_HIGH, T.StringType()),
    T.StructField(TEMP_AVG, T.StringType()),
    T.StructField(TEMP_LOW, T.StringType()),
    T.StructField(FEELS_LIKE, T.StringType()),
    T.StructField(SOLAR_MAX, T.StringType()),
    T.StructField(GAS_DEMAND, T.StringType()),
    T.StructField(DAY_TYPE, T.StringType()),
    T.StructField(WEEKDAY_NAME, T.StringType()),
])
