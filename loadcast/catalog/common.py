"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.functions import calendar as cal
from loadcast.sources import panels


def exact_avg(c: Column) -> Column:
    """Mean of a 2-decimal money column, summed exactly as a decimal."""
    return F.sum(c.cast("decimal(18,2)")).cast("double") / F.count(c)


def r6(c: Column) -> Column:
    """Rounding used where a result is a mean of doubles (order-dependent bits)."""
    return F.round(c, 6)


def demand(spark: SparkSession, sf: str) -> DataFrame:
    return panels.demand_panel(spark, sf)


def demand_cal(spark: SparkSession, sf: str) -> DataFrame:
    """Dense panel with calendar columns (weekday, holiday, business day, parts, seasons)."""
    out = cal.prepare_calendar(demand(spark, sf))
    out = cal.calendar_parts(out)
    return cal.season_flags(out)


def region_cal(spark: SparkSession, sf: str) -> DataFrame:
    out = cal.prepare_calendar(panels.region_panel(spark, sf))
    out = cal.calendar_parts(out)
    return cal.season_flags(out)
