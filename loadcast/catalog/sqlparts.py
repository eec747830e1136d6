"""Shared DuckDB SQL fragments for the oracle twins of the registered queries.

Each fragment mirrors one Spark building block exactly: money sums as
decimals, weekday as ``isodow - 1``, the fixed-date holiday list, the stand-in
temperatures and the row-based lags.
"""

from __future__ import annotations

from loadcast import schema as S

HOLIDAY_CODES = ", ".join(str(m * 100 + d) for m, d, _ in S.FIXED_DATE_HOLIDAYS)

# Lunar New Year, Buddha's Birthday and Mid-Autumn Festival of the years of the test
# tables, as published.
LUNAR_NEW_YEARS = ("1992-02-04 1993-01-23 1994-02-10 1995-01-31 1996-02-19 1997-02-08 1998-01-28 1999-02-16 2000-02-05 2001-01-24 2002-02-12 "
                   "2003-02-01 2004-01-22 2005-02-09 2023-01-22 2024-02-10 2025-01-29").split()
BUDDHAS_BIRTHDAYS = ("1992-05-10 1993-05-28 1994-05-18 1995-05-07 1996-05-24 1997-05-14 1998-05-03 1999-05-22 2000-05-11 2001-05-01 2002-05-19 "
                     "2003-05-08 2004-05-26 2005-05-15 2023-05-27 2024-05-15 2025-05-05").split()
MID_AUTUMNS = ("1992-09-11 1993-09-30 1994-09-20 1995-09-09 1996-09-27 1997-09-16 1998-10-05 1999-09-24 2000-09-12 2001-10-01 2002-09-21 "
               "2003-09-11 2004-09-28 2005-09-18 2023-09-29 2024-09-17 2025-10-06").split()
OTHERS = ("2023-01-24 2023-05-29 2024-02-12 2024-05-06 2025-03-03 2025-05-06 2025-10-08".split(),
          "2023-10-02 2024-10-01 2025-01-27".split(), "2024-04-10 2025-06-03".split())
MOVING_SQL = f"""
  SELECT t.d::DATE + k.k AS d, 'Lunar New Year' AS name FROM (SELECT unnest({LUNAR_NEW_YEARS}) AS d) t, (SELECT unnest([-1, 0, 1]) AS k) k
  UNION ALL SELECT t.d::DATE + k.k, 'Mid-Autumn Festival' FROM (SELECT unnest({MID_AUTUMNS}) AS d) t, (SELECT unnest([-1, 0, 1]) AS k) k
  UNION ALL SELECT unnest({BUDDHAS_BIRTHDAYS})::DATE, 'Buddha''s Birthday'
  UNION ALL SELECT unnest({OTHERS[0]})::DATE, 'Substitute'
  UNION ALL SELECT unnest({OTHERS[1]})::DATE, 'Temporary Holiday'
  UNION ALL SELECT unnest({OTHERS[2]})::DATE, 'Election Day'"""

LINEITEM_PANEL = """
lineitem_panel AS (
  SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS date,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS max_demand,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(15,2))) AS DOUBLE) AS solar_max,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(15,2))) AS DOUBLE) AS gas_demand
  FROM lineitem GROUP BY 1, 2
)"""

REGION_PANEL_RAW = """
region_panel_raw AS (
  SELECT CAST(n.n_regionkey AS VARCHAR) AS series_id, CAST(o.o_orderdate AS DATE) AS date,
         CAST(SUM(CAST(o.o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS max_demand
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY 1, 2
)"""

EVENTS_PANEL_RAW = """
events_panel_raw AS (
  SELECT event_type AS series_id, CAST(ts AS DATE) AS date, MAX(value) AS max_demand
  FROM events GROUP BY 1, 2
)"""


def temps(src: str, name: str) -> str:
    """Stand-in temperatures over the CTE ``src``."""
    hi = "(33 - ABS(dayofyear(date) - 200) // 4)"
    lo = f"({hi} - 5 - (day(date) % 5))"
    fe = f"({hi} - (day(date) % 3))"
    miss = "day(date) % 17 = 0"
    return f"""
{name} AS (
  SELECT *,
    CASE WHEN {miss} THEN NULL ELSE CAST({hi} AS DOUBLE) END AS temp_high,
    CASE WHEN {miss} THEN NULL ELSE CAST({lo} AS DOUBLE) END AS temp_low,
    CASE WHEN {miss} THEN NULL ELSE CAST({fe} AS DOUBLE) END AS feels_like,
    CASE WHEN {miss} THEN NULL ELSE ({hi} + {lo}) / 2.0 END AS temp_avg
  FROM {src}
)"""


def calendar(src: str, name: str) -> str:
    """Weekday, holiday, business day, day type, calendar parts and seasons."""
    return f"""
{name} AS (
  SELECT *,
    CASE WHEN weekday_num < 5 AND is_holiday = 0 THEN 1 ELSE 0 END AS is_business_day,
    CASE WHEN weekday_num < 5 AND is_holiday = 0 THEN 'weekday' ELSE 'holiday' END AS day_type
  FROM (
    SELECT *,
      CAST(isodow(date) - 1 AS INTEGER) AS weekday_num,
      CAST(CASE WHEN month(date) * 100 + day(date) IN ({HOLIDAY_CODES}) OR date IN (SELECT d FROM ({MOVING_SQL})) THEN 1 ELSE 0 END AS INTEGER) AS is_holiday,
      CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
      CAST(day(date) AS INTEGER) AS day,
      CAST(CASE WHEN month(date) BETWEEN 5 AND 9 THEN 1 ELSE 0 END AS INTEGER) AS is_summer,
      CAST(CASE WHEN month(date) BETWEEN 5 AND 9 THEN 0 ELSE 1 END AS INTEGER) AS is_winter
    FROM {src}
  )
)"""


def lags(src: str, name: str) -> str:
    w = "OVER (PARTITION BY series_id ORDER BY date)"
    return f"""
{name} AS (
  SELECT *, LAG(max_demand, 1) {w} AS demand_lag1, LAG(max_demand, 7) {w} AS demand_lag7
  FROM {src}
)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


DEMAND = with_ctes(LINEITEM_PANEL, temps("lineitem_panel", "panel"))
DEMAND_CAL = with_ctes(LINEITEM_PANEL, temps("lineitem_panel", "panel"),
                       calendar("panel", "cal"))
DEMAND_LAGS = with_ctes(LINEITEM_PANEL, temps("lineitem_panel", "panel"),
                        calendar("panel", "cal"), lags("cal", "lagged"))
REGION = with_ctes(REGION_PANEL_RAW, temps("region_panel_raw", "panel"))
REGION_CAL = with_ctes(REGION_PANEL_RAW, temps("region_panel_raw", "panel"),
                       calendar("panel", "cal"))
EVENTS = with_ctes(EVENTS_PANEL_RAW, temps("events_panel_raw", "panel"))


def exact_avg(expr: str) -> str:
    """Order-independent mean of a 2-decimal money expression."""
    return f"CAST(SUM(CAST({expr} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({expr})"
