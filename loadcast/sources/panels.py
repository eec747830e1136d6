"""Daily panels ``(series_id, date, measures...)`` built from the test tables.

Every panel is aggregated to one row per (series, date) before any window
runs. That aggregation is a partial (map-side) hash aggregate followed by one
shuffle on (series, date), so a hot series in the raw table only costs one
partial row per task and date; afterwards a series holds at most one row per
calendar day, which bounds every per-series window partition downstream.

Money columns are summed as decimals (exact, order independent) and cast to
double once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.operators.joins import broadcast_if_small

MONEY = "decimal(15,2)"
# Largest nation table that is broadcast (rows, proven by a bounded count).
NATION_BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _money(c: str) -> Column:
    return F.col(c).cast(MONEY)


def lineitem_panel(lineitem: DataFrame) -> DataFrame:
    """Dense panel: one series per return flag, demand/solar/gas from prices."""
    price = _money("l_extendedprice")
    return (
        lineitem
        .select(F.col("l_returnflag").alias(S.SERIES),
                F.to_date("l_shipdate").alias(S.DATE),
                price.alias("_p"),
                (price * _money("l_discount")).alias("_s"),
                (price * _money("l_tax")).alias("_g"))
        .groupBy(S.SERIES, S.DATE)
        .agg(F.sum("_p").cast("double").alias(S.MAX_DEMAND),
             F.sum("_s").cast("double").alias(S.SOLAR_MAX),
             F.sum("_g").cast("double").alias(S.GAS_DEMAND))
    )


def orders_region_panel(orders: DataFrame, customer: DataFrame,
                        nation: DataFrame) -> DataFrame:
    """Sparse panel: one series per region; days without orders are missing.

    nation is a small dimension (25 rows in the test tables): broadcast after
    a bounded row count proves it small, otherwise joined by shuffle. customer
    is joined on its key (Spark and AQE decide broadcast vs shuffle from the
    runtime size).
    """
    cust = customer.select("c_custkey", "c_nationkey")
    nat = broadcast_if_small(nation.select("n_nationkey", "n_regionkey"), NATION_BROADCAST_ROWS)
    return (
        orders.select("o_custkey", "o_orderdate", "o_totalprice")
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_regionkey").cast("string").alias(S.SERIES),
                F.to_date("o_orderdate").alias(S.DATE),
                _money("o_totalprice").alias("_p"))
        .groupBy(S.SERIES, S.DATE)
        .agg(F.sum("_p").cast("double").alias(S.MAX_DEMAND))
    )


def events_peak_panel(events: DataFrame) -> DataFrame:
    """Peak panel: daily max of ``value`` per event type."""
    return (
        events.select(F.col("event_type").alias(S.SERIES),
                      F.to_date("ts").alias(S.DATE), "value")
        .groupBy(S.SERIES, S.DATE)
        .agg(F.max("value").alias(S.MAX_DEMAND))
    )


def with_temperatures(panel: DataFrame) -> DataFrame:
    """Deterministic stand-in temperatures derived from the date.

    high = 33 - |day_of_year - 200| div 4, low = high - 5 - (day % 5),
    feels = high - (day % 3), avg = (high + low) / 2; all null on days where
    day % 17 = 0.
    """
    d = F.col(S.DATE)
    dom = F.dayofmonth(d)
    high = F.lit(33) - F.floor(F.abs(F.dayofyear(d) - F.lit(200)) / 4)
    missing = (dom % 17) == 0
    low = high - 5 - (dom % 5)
    feels = high - (dom % 3)

    def nul(x: Column) -> Column:
        return F.when(missing, F.lit(None).cast("double")).otherwise(x.cast("double"))

    return panel.withColumns({
        S.TEMP_HIGH: nul(high),
        S.TEMP_LOW: nul(low),
        S.FEELS_LIKE: nul(feels),
        S.TEMP_AVG: nul((high + low) / 2.0),
    })


def demand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense lineitem panel with stand-in temperatures (the main input)."""
    return with_temperatures(lineitem_panel(read_table(spark, sf_dir, "lineitem")))


def region_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_temperatures(orders_region_panel(
        read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"),
        read_table(spark, sf_dir, "nation")))


def peak_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_temperatures(events_peak_panel(read_table(spark, sf_dir, "events")))
