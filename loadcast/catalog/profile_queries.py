"""Registered queries for profiling (D3 describe, D4 value counts, D5 null counts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.catalog import sqlparts as Q
from loadcast.catalog.common import demand, r6
from loadcast.catalog.change_queries import RAW_SQL, NUM_SQL, raw_sheet
from loadcast.operators import profile as pr
from loadcast.sources import ingest as io
from loadcast.sources.panels import read_table

DESCRIBE_COLS = [S.MAX_DEMAND, S.SOLAR_MAX, S.GAS_DEMAND, S.TEMP_HIGH, S.TEMP_LOW,
                 S.FEELS_LIKE, S.TEMP_AVG]


def d3_describe(spark, sf):
    d = pr.describe(demand(spark, sf), DESCRIBE_COLS)
    return d.select("column_name", "count", *[r6(F.col(c)).alias(c) for c in
                                              ("mean", "std", "min", "p25", "p50", "p75", "max")])


D3_SQL = Q.DEMAND + "\n" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean,
       ROUND(STDDEV_SAMP({c}), 6) AS std, ROUND(MIN({c}), 6) AS min,
       ROUND(QUANTILE_CONT({c}, 0.25::DOUBLE), 6) AS p25, ROUND(QUANTILE_CONT({c}, 0.5::DOUBLE), 6) AS p50,
       ROUND(QUANTILE_CONT({c}, 0.75::DOUBLE), 6) AS p75, ROUND(MAX({c}), 6) AS max FROM panel"""
    for c in DESCRIBE_COLS) + "\n"


def d4_value_counts(spark, sf):
    o = read_table(spark, sf, "orders")
    return pr.value_counts(o, ["o_orderstatus", "o_orderpriority"])


D4_SQL = """
SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, COUNT(*) AS count
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'o_orderpriority', o_orderpriority, COUNT(*) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2
"""


def d5_null_counts(spark, sf):
    """Null counts of the coerced sheet (bad numbers and missing temperatures)."""
    sheet = raw_sheet(spark, sf).select(S.SERIES, F.col("demand_text").alias(S.MAX_DEMAND),
                                        S.TEMP_HIGH, S.TEMP_LOW)
    return pr.null_counts(io.coerce_numeric(sheet, [S.MAX_DEMAND, S.TEMP_HIGH, S.TEMP_LOW]))


D5_SQL = RAW_SQL + f"""
, c AS (SELECT series_id, {NUM_SQL.format(x='demand_text')} AS max_demand, temp_high, temp_low FROM raw)
SELECT * FROM (
  SELECT 'series_id' AS column_name, COUNT(*) - COUNT(series_id) AS n_null FROM c
  UNION ALL SELECT 'max_demand', COUNT(*) - COUNT(max_demand) FROM c
  UNION ALL SELECT 'temp_high', COUNT(*) - COUNT(temp_high) FROM c
  UNION ALL SELECT 'temp_low', COUNT(*) - COUNT(temp_low) FROM c)
WHERE n_null > 0
"""


QUERIES = {
    "d3_describe": (d3_describe, D3_SQL),
    "d4_value_counts": (d4_value_counts, D4_SQL),
    "d5_null_counts": (d5_null_counts, D5_SQL),
}
