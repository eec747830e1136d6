"""Registered queries for lookups (E2-E7) on the sparse region panel.

Targets are every calendar day from each series' first date to the day after
its last date, so gaps in the sparse panel exercise the fallbacks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.catalog import sqlparts as Q
from loadcast.catalog.common import region_cal
from loadcast.functions import calendar as cal
from loadcast.operators import lookup as lk

KEYS = [S.SERIES, S.DATE]


def calendar_targets(history):
    """Every day from each series' first date to the day after its last date."""
    span = history.groupBy(S.SERIES).agg(F.min(S.DATE).alias("_lo"), F.max(S.DATE).alias("_hi"))
    return span.select(S.SERIES, F.explode(F.sequence("_lo", F.date_add("_hi", 1))).alias(S.DATE))


TARGETS_SQL = """
, targets AS (
  SELECT series_id, CAST(UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi + 1 AS TIMESTAMP),
                                                INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT series_id, MIN(date) AS lo, MAX(date) AS hi FROM panel GROUP BY 1)
)
"""


def e2_holiday_membership(spark, sf):
    """Holiday flag with a dimension of moving dates (every 59th day of the calendar),
    which no month and day rule can stand in for."""
    hist = region_cal(spark, sf)
    t = calendar_targets(hist)
    moving = t.where(F.pmod(F.unix_date(S.DATE), F.lit(59)) == 7).select(S.DATE).distinct()
    return cal.with_holiday_flag(t, extra_holidays=moving).select(*KEYS, S.IS_HOLIDAY)


E2_SQL = Q.REGION + TARGETS_SQL + f"""
SELECT series_id, date,
  CAST(CASE WHEN month(date) * 100 + day(date) IN ({Q.HOLIDAY_CODES})
         OR (date - DATE '1970-01-01') % 59 = 7 THEN 1 ELSE 0 END AS INTEGER) AS is_holiday
FROM targets
"""


def e3_observed_on(spark, sf):
    hist = region_cal(spark, sf)
    t = calendar_targets(hist)
    out = lk.observed_on(t, hist, [S.TEMP_LOW, S.TEMP_HIGH, S.FEELS_LIKE])
    return out.select(*KEYS, "obs_temp_low", "obs_temp_high", "obs_feels_like")


E3_SQL = Q.REGION + TARGETS_SQL + """
SELECT t.series_id, t.date, p.temp_low AS obs_temp_low, p.temp_high AS obs_temp_high,
       p.feels_like AS obs_feels_like
FROM targets t LEFT JOIN panel p ON p.series_id = t.series_id AND p.date = t.date
"""


def e3_observed_first_match(spark, sf):
    """History that repeats dates: odd days come twice, the later copy two degrees lower."""
    hist = region_cal(spark, sf).select(*KEYS, S.TEMP_LOW).withColumn("seq", F.lit(2))
    again = (hist.where(F.dayofmonth(S.DATE) % 2 == 1)
             .withColumns({S.TEMP_LOW: F.col(S.TEMP_LOW) - 2.0, "seq": F.lit(1)}))
    out = lk.observed_on(calendar_targets(hist), hist.unionByName(again), [S.TEMP_LOW],
                         tiebreak="seq")
    return out.select(*KEYS, "obs_temp_low")


E3_FIRST_SQL = Q.REGION + TARGETS_SQL + """
SELECT t.series_id, t.date,
       CASE WHEN day(t.date) % 2 = 1 THEN p.temp_low - 2.0 ELSE p.temp_low END AS obs_temp_low
FROM targets t LEFT JOIN panel p ON p.series_id = t.series_id AND p.date = t.date
"""


def e4_last_before(spark, sf):
    hist = region_cal(spark, sf)
    t = calendar_targets(hist)
    return lk.last_before(t, hist, S.MAX_DEMAND, out="last_demand")


E4_SQL = Q.REGION + TARGETS_SQL + """
, h AS (SELECT series_id, date AS hdate, max_demand FROM panel WHERE max_demand IS NOT NULL)
SELECT t.series_id, t.date, h.max_demand AS last_demand, h.hdate AS last_demand_date
FROM targets t ASOF LEFT JOIN h ON t.series_id = h.series_id AND t.date > h.hdate
"""


def e5_same_dow_last_week(spark, sf):
    hist = region_cal(spark, sf)
    return lk.same_dow_last_week(calendar_targets(hist), hist)


E5_SQL = Q.REGION + TARGETS_SQL + """
, h AS (SELECT series_id, date, max_demand,
               ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS pos
        FROM panel WHERE max_demand IS NOT NULL)
, c AS (SELECT t.series_id, t.date,
               (SELECT COUNT(*) FROM h WHERE h.series_id = t.series_id AND h.date < t.date) AS cnt
        FROM targets t)
SELECT c.series_id, c.date, COALESCE(e.max_demand, f.max_demand, 0.0) AS demand_last_week
FROM c LEFT JOIN h e ON e.series_id = c.series_id AND e.date = c.date - 7
       LEFT JOIN h f ON f.series_id = c.series_id AND f.pos = c.cnt - 6
"""


def e6_same_week_last_year(spark, sf):
    hist = region_cal(spark, sf)
    return lk.same_week_last_year(calendar_targets(hist), hist)


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in S.WEEKDAY_NAMES) + "]"
E6_SQL = Q.REGION + TARGETS_SQL + f"""
, w AS (SELECT series_id, date AS target_date,
               CAST(date_trunc('week', CAST(date - INTERVAL 1 YEAR AS DATE)) AS DATE) + CAST(i AS INTEGER) AS date
        FROM targets, range(0, 7) r(i))
SELECT w.series_id, w.target_date, w.date, {_NAMES_SQL}[isodow(w.date)] AS weekday_name,
       p.max_demand
FROM w LEFT JOIN panel p ON p.series_id = w.series_id AND p.date = w.date
"""


def e7_next_target_date(spark, sf):
    return lk.next_target_date(region_cal(spark, sf))


E7_SQL = Q.REGION + "SELECT series_id, CAST(MAX(date) + 1 AS DATE) AS date FROM panel GROUP BY 1\n"


QUERIES = {
    "e3_observed_first_match": (e3_observed_first_match, E3_FIRST_SQL),
    "e2_holiday_membership": (e2_holiday_membership, E2_SQL),
    "e3_observed_on": (e3_observed_on, E3_SQL),
    "e4_last_before": (e4_last_before, E4_SQL),
    "e5_same_dow_last_week": (e5_same_dow_last_week, E5_SQL),
    "e6_same_week_last_year": (e6_same_week_last_year, E6_SQL),
    "e7_next_target_date": (e7_next_target_date, E7_SQL),
}
