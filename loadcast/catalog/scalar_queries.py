"""Registered queries for calendar and scalar operators (B3-B28) + flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.sources.panels import read_table
from loadcast.catalog import sqlparts as Q
from loadcast.catalog.common import demand, demand_cal, exact_avg, region_cal
from loadcast.functions import calendar as cal
from loadcast.functions import scalars as sc
from loadcast.operators import features as fe

KEYS = [S.SERIES, S.DATE]


# --- flagship: lags -> business-day / month error table -------------------------

def flagship_lag_error(spark, sf):
    """Panel -> calendar -> lag1 / lag7 -> drop nulls -> mean demand and lag error."""
    df = fe.demand_lags(demand_cal(spark, sf))
    df = df.na.drop(subset=[S.DEMAND_LAG1, S.DEMAND_LAG7])
    return (df.groupBy(S.SERIES, S.MONTH, S.IS_BUSINESS_DAY)
            .agg(F.count("*").alias("n_days"),
                 exact_avg(F.col(S.MAX_DEMAND)).alias("avg_demand"),
                 exact_avg(F.abs(F.col(S.MAX_DEMAND) - F.col(S.DEMAND_LAG1))).alias("mae_lag1"),
                 exact_avg(F.abs(F.col(S.MAX_DEMAND) - F.col(S.DEMAND_LAG7))).alias("mae_lag7")))


FLAGSHIP_SQL = Q.DEMAND_LAGS + f"""
SELECT series_id, month, is_business_day, COUNT(*) AS n_days,
       {Q.exact_avg('max_demand')} AS avg_demand,
       {Q.exact_avg('ABS(max_demand - demand_lag1)')} AS mae_lag1,
       {Q.exact_avg('ABS(max_demand - demand_lag7)')} AS mae_lag7
FROM lagged WHERE demand_lag1 IS NOT NULL AND demand_lag7 IS NOT NULL
GROUP BY 1, 2, 3
"""


# --- B3 .. B10 ------------------------------------------------------------------

def b3_calendar_parts(spark, sf):
    return cal.calendar_parts(demand(spark, sf)).select(*KEYS, S.YEAR, S.MONTH, S.DAY)


B3_SQL = Q.DEMAND + """
SELECT series_id, date, CAST(year(date) AS INTEGER) AS year,
       CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day
FROM panel
"""


def b4_weekday_name(spark, sf):
    return cal.with_weekday(demand(spark, sf)).select(*KEYS, S.WEEKDAY_NUM, S.WEEKDAY_NAME)


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in S.WEEKDAY_NAMES) + "]"
B4_SQL = Q.DEMAND + f"""
SELECT series_id, date, CAST(isodow(date) - 1 AS INTEGER) AS weekday_num,
       {_NAMES_SQL}[isodow(date)] AS weekday_name
FROM panel
"""


def b5_holiday_flag(spark, sf):
    """Holiday flag on the sparse region panel, with the holiday dimension joined
    for the holiday name (a bounded table: 8 rows per calendar year)."""
    df = cal.with_holiday_flag(region_cal(spark, sf).drop(S.IS_HOLIDAY), moving=True)
    dim = cal.holiday_calendar(df)
    return (df.join(F.broadcast(dim.withColumnRenamed("name", "holiday_name")),
                    S.DATE, "left")
            .select(*KEYS, S.IS_HOLIDAY, "holiday_name"))


_HOLIDAY_NAMES_SQL = " ".join(
    f"WHEN {m * 100 + d} THEN '{n.replace(chr(39), chr(39) * 2)}'"
    for m, d, n in S.FIXED_DATE_HOLIDAYS)
B5_SQL = Q.REGION_CAL + f"""
SELECT series_id, date, is_holiday,
       CASE month(date) * 100 + day(date) {_HOLIDAY_NAMES_SQL} END AS holiday_name
FROM cal
"""


def b5_lunar_holidays(spark, sf):
    """Moving holidays of every year in which there are orders, with the orders of each day."""
    orders = read_table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias(S.DATE))
    per_day = orders.groupBy(S.DATE).agg(F.count(F.lit(1)).alias("n_orders"))
    return (cal.moving_holiday_calendar(per_day).join(per_day, S.DATE, "left")
            .select(S.DATE, "name", F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders")))


B5_LUNAR_SQL = f"""
SELECT d AS date, name, (SELECT count(*) FROM orders WHERE o_orderdate::DATE = d) AS n_orders
FROM ({Q.MOVING_SQL}) m WHERE year(d) IN (SELECT year(o_orderdate) FROM orders)
"""


def b6_business_day(spark, sf):
    return demand_cal(spark, sf).select(*KEYS, S.WEEKDAY_NUM, S.IS_HOLIDAY, S.IS_BUSINESS_DAY)


B6_SQL = Q.DEMAND_CAL + """
SELECT series_id, date, weekday_num, is_holiday, is_business_day FROM cal
"""


def b7_day_type_default(spark, sf):
    return demand_cal(spark, sf).select(*KEYS, S.DAY_TYPE)


B7_SQL = Q.DEMAND_CAL + "SELECT series_id, date, day_type FROM cal\n"


def _raw_day_type(d):
    """Deterministic free-form day-type text derived from the date (for B8)."""
    dom = F.dayofmonth(d)
    return (F.when(dom % 7 == 0, F.lit(" Weekday "))
            .when(dom % 7 == 1, F.lit("근무일"))
            .when(dom % 7 == 2, F.lit("주말"))
            .when(dom % 7 == 3, F.lit("???"))
            .when(dom % 7 == 4, F.lit(None).cast("string"))
            .when(dom % 7 == 5, F.lit("HOLIDAY"))
            .otherwise(F.lit("public holiday")))


_RAW_DAY_TYPE_SQL = """CASE day(date) % 7 WHEN 0 THEN ' Weekday ' WHEN 1 THEN '근무일'
  WHEN 2 THEN '주말' WHEN 3 THEN '???' WHEN 4 THEN NULL WHEN 5 THEN 'HOLIDAY'
  ELSE 'public holiday' END"""


def b8_normalize_day_type(spark, sf):
    df = demand_cal(spark, sf).drop(S.DAY_TYPE)
    df = df.withColumn("raw_day_type", _raw_day_type(F.col(S.DATE)))
    df = df.withColumn(S.DAY_TYPE, F.col("raw_day_type"))
    return cal.normalize_day_type(df).select(*KEYS, "raw_day_type", S.DAY_TYPE)


_WD_SYN = ", ".join(f"'{v}'" for v in S.DAY_TYPE_WEEKDAY_SYNONYMS)
_HD_SYN = ", ".join(f"'{v}'" for v in S.DAY_TYPE_HOLIDAY_SYNONYMS)
B8_SQL = Q.DEMAND_CAL + f"""
SELECT series_id, date, raw_day_type,
  CASE WHEN lower(trim(raw_day_type)) IN ({_WD_SYN}) THEN 'weekday'
       WHEN lower(trim(raw_day_type)) IN ({_HD_SYN}) THEN 'holiday'
       ELSE day_type END AS day_type
FROM (SELECT *, {_RAW_DAY_TYPE_SQL} AS raw_day_type FROM cal)
"""


def b9_one_hot(spark, sf):
    df = cal.with_weekday(demand(spark, sf))
    # Null weekday names on days 13 exercise the all-zero row.
    df = df.withColumn(S.WEEKDAY_NAME, F.when(F.dayofmonth(S.DATE) != 13,
                                              F.col(S.WEEKDAY_NAME)))
    out = cal.weekday_one_hot(df)
    return out.select(*KEYS, *S.DOW_COLUMNS)


B9_SQL = Q.DEMAND + """
SELECT series_id, date, """ + ", ".join(
    f"CAST(CASE WHEN day(date) <> 13 AND isodow(date) = {i + 1} THEN 1 ELSE 0 END AS INTEGER) AS {c}"
    for i, c in enumerate(S.DOW_COLUMNS)) + """
FROM panel
"""


def b10_season_flags(spark, sf):
    return demand_cal(spark, sf).select(*KEYS, S.MONTH, S.IS_SUMMER, S.IS_WINTER)


B10_SQL = Q.DEMAND_CAL + "SELECT series_id, date, month, is_summer, is_winter FROM cal\n"


# --- B11 .. B19 -----------------------------------------------------------------

def b11_cooling_intensity(spark, sf):
    df = sc.cooling_intensity(demand_cal(spark, sf)).withColumnRenamed(S.COOLING, "_first")
    # Second variant: no feels_like column -> temp_high is used.
    alt = sc.cooling_intensity(df.drop(S.FEELS_LIKE))
    return alt.select(*KEYS, F.col("_first").alias(S.COOLING),
                      F.col(S.COOLING).alias("cooling_from_high"))


B11_SQL = Q.DEMAND_CAL + """
SELECT series_id, date,
  CASE WHEN feels_like IS NULL THEN NULL ELSE greatest(feels_like - 25.0, 0.0) END * is_summer AS cooling_intensity,
  CASE WHEN temp_high IS NULL THEN NULL ELSE greatest(temp_high - 25.0, 0.0) END * is_summer AS cooling_from_high
FROM cal
"""


def b12_heating_intensity(spark, sf):
    return sc.heating_intensity(demand_cal(spark, sf)).select(*KEYS, S.HEATING)


B12_SQL = Q.DEMAND_CAL + """
SELECT series_id, date,
  CASE WHEN temp_low IS NULL THEN NULL ELSE greatest(10.0 - temp_low, 0.0) END * is_winter AS heating_intensity
FROM cal
"""


def b13_diurnal_range(spark, sf):
    return sc.diurnal_range(demand(spark, sf)).select(*KEYS, S.DIURNAL)


B13_SQL = Q.DEMAND + "SELECT series_id, date, temp_high - temp_low AS diurnal_range FROM panel\n"


def b14_residual_load(spark, sf):
    return sc.residual_and_ratios(demand(spark, sf)).select(*KEYS, S.RESIDUAL_LOAD)


B14_SQL = Q.DEMAND + "SELECT series_id, date, max_demand - solar_max AS residual_load FROM panel\n"


def b15_demand_ratios(spark, sf):
    df = demand(spark, sf)
    # Zero and missing demand on some days exercise the 0 fallback.
    dom = F.dayofmonth(S.DATE)
    df = df.withColumn(S.MAX_DEMAND, F.when(dom == 11, F.lit(0.0))
                       .when(dom == 12, F.lit(None).cast("double"))
                       .otherwise(F.col(S.MAX_DEMAND)))
    return sc.residual_and_ratios(df).select(*KEYS, S.SOLAR_RATIO, S.RESIDUAL_RATIO)


B15_SQL = Q.DEMAND + """
SELECT series_id, date,
  COALESCE(solar_max / NULLIF(d, 0.0), 0.0) AS solar_ratio,
  COALESCE((d - solar_max) / NULLIF(d, 0.0), 0.0) AS residual_ratio
FROM (SELECT *, CASE WHEN day(date) = 11 THEN 0.0 WHEN day(date) = 12 THEN NULL
                     ELSE max_demand END AS d FROM panel)
"""


def b16_gas_budget(spark, sf):
    df = fe.gas_features(demand_cal(spark, sf))
    return df.select(*KEYS, F.round(S.GAS_BUDGET, 4).alias(S.GAS_BUDGET))


B16_SQL = Q.DEMAND_CAL + """
, r AS (
  SELECT *, (gas_demand + solar_max) / NULLIF(max_demand, 0.0) AS ratio FROM cal
), m AS (
  SELECT *,
    COALESCE(AVG(CASE WHEN is_business_day = 1 THEN ratio END) OVER (PARTITION BY series_id),
             AVG(ratio) OVER (PARTITION BY series_id), 0.0) AS rb,
    COALESCE(AVG(CASE WHEN is_business_day = 0 THEN ratio END) OVER (PARTITION BY series_id),
             AVG(ratio) OVER (PARTITION BY series_id), 0.0) AS ro
  FROM r
)
SELECT series_id, date,
  ROUND(CASE WHEN x IS NULL THEN NULL ELSE greatest(x, 0.0) END, 4) AS gas_budget
FROM (SELECT *, max_demand * CASE WHEN is_business_day = 1 THEN rb ELSE ro END - solar_max AS x FROM m)
"""


def b17_fill_lags(spark, sf):
    df = fe.demand_lags(demand_cal(spark, sf))
    df = fe.last_year_dow_mean(df)
    # Blank the means of one weekday, so the third lag has nulls to fill too.
    df = df.withColumn(S.DEMAND_LAST_YEAR_DOW, F.when(F.col(S.WEEKDAY_NUM) != 2,
                                                      F.col(S.DEMAND_LAST_YEAR_DOW)))
    return sc.fill_lags(df).select(*KEYS, S.DEMAND_LAG1, S.DEMAND_LAG7,
                                   F.round(S.DEMAND_LAST_YEAR_DOW, 6).alias(S.DEMAND_LAST_YEAR_DOW))


B17_SQL = Q.DEMAND_LAGS + """
, m AS (SELECT series_id, year, month, weekday_num, AVG(max_demand) AS mm FROM lagged GROUP BY 1, 2, 3, 4)
SELECT c.series_id, c.date, COALESCE(c.demand_lag1, 0.0) AS demand_lag1,
       COALESCE(c.demand_lag7, 0.0) AS demand_lag7,
       ROUND(COALESCE(CASE WHEN c.weekday_num <> 2 THEN m.mm END, 0.0), 6) AS demand_last_year_dow
FROM lagged c LEFT JOIN m ON m.series_id = c.series_id AND m.year = c.year - 1
  AND m.month = c.month AND m.weekday_num = c.weekday_num
"""


def b18_drop_essential_nulls(spark, sf):
    """Lags first, then rows with a missing demand (day 5 blanked) are dropped."""
    df = demand_cal(spark, sf)
    df = df.withColumn(S.MAX_DEMAND, F.when(F.dayofmonth(S.DATE) != 5, F.col(S.MAX_DEMAND)))
    df = fe.demand_lags(df)
    return sc.drop_essential_nulls(df).select(*KEYS, S.MAX_DEMAND, S.DEMAND_LAG1)


B18_SQL = Q.DEMAND_CAL + """
, b AS (SELECT series_id, date, month,
               CASE WHEN day(date) <> 5 THEN max_demand END AS max_demand FROM cal)
SELECT series_id, date, max_demand, demand_lag1 FROM (
  SELECT *, LAG(max_demand, 1) OVER (PARTITION BY series_id ORDER BY date) AS demand_lag1 FROM b)
WHERE max_demand IS NOT NULL AND month IS NOT NULL
"""


def b19_complete_cases(spark, sf):
    df = fe.demand_lags(demand_cal(spark, sf))
    feats = [S.TEMP_HIGH, S.TEMP_LOW, S.DEMAND_LAG1, S.DEMAND_LAG7]
    return sc.complete_cases(df, feats, S.MAX_DEMAND).select(*KEYS, *feats, S.MAX_DEMAND)


B19_SQL = Q.DEMAND_LAGS + """
SELECT series_id, date, temp_high, temp_low, demand_lag1, demand_lag7, max_demand FROM lagged
WHERE temp_high IS NOT NULL AND temp_low IS NOT NULL AND demand_lag1 IS NOT NULL
  AND demand_lag7 IS NOT NULL AND max_demand IS NOT NULL
"""


# --- B24 .. B28, F8 ---------------------------------------------------------------

def b24_align_features(spark, sf):
    """Features reordered to a training list with one name absent (-> 0.0) and
    extra columns dropped."""
    df = demand_cal(spark, sf)
    names = [S.MONTH, S.TEMP_LOW, "solar_share_unused", S.TEMP_HIGH]
    return sc.align_features(df, names, keep=KEYS)


B24_SQL = Q.DEMAND_CAL + """
SELECT series_id, date, month, temp_low, 0.0::DOUBLE AS solar_share_unused, temp_high FROM cal
"""


def _inputs(df):
    """Deterministic supplied temperatures for forecast rows."""
    return df.withColumns({
        "in_low": F.col(S.DAY).cast("double") - 10.0,
        "in_high": F.col(S.DAY).cast("double") + 10.0,
        "in_feels": F.when(F.col(S.DAY) % 4 != 0, F.col(S.DAY).cast("double")),
    })


def b25_fallback_temperatures(spark, sf):
    df = _inputs(demand_cal(spark, sf))
    cols = sc.fallback_temperatures(
        F.col(S.TEMP_LOW), F.col(S.TEMP_HIGH), F.col(S.FEELS_LIKE),
        F.col("in_low"), F.col("in_high"), F.col("in_feels"),
        F.col(S.IS_SUMMER), F.col(S.IS_WINTER))
    return df.select(*KEYS, *[c.alias(n) for n, c in cols.items()])


B25_SQL = Q.DEMAND_CAL + """
, i AS (SELECT *, CAST(day AS DOUBLE) - 10.0 AS in_low, CAST(day AS DOUBLE) + 10.0 AS in_high,
               CASE WHEN day % 4 <> 0 THEN CAST(day AS DOUBLE) END AS in_feels FROM cal)
, f AS (SELECT *, COALESCE(temp_low, CASE WHEN is_winter = 1 THEN in_low END) AS lo,
               COALESCE(temp_high, CASE WHEN is_summer = 1 THEN in_high END) AS hi FROM i)
SELECT series_id, date, lo AS temp_low, hi AS temp_high,
  COALESCE(feels_like, in_feels,
           CASE WHEN is_summer = 1 AND hi IS NOT NULL THEN hi END,
           CASE WHEN is_winter = 1 AND lo IS NOT NULL THEN lo END,
           (COALESCE(lo, 0.0) + COALESCE(hi, 0.0)) / 2.0) AS feels_like
FROM f
"""


def b26_business_day_override(spark, sf):
    df = demand_cal(spark, sf)
    supplied = F.when(F.dayofmonth(S.DATE) % 3 == 0, F.lit(None).cast("string")) \
        .when(F.dayofmonth(S.DATE) % 3 == 1, F.lit("weekday")).otherwise(F.lit("holiday"))
    flag = cal.business_day_override(F.col(S.IS_HOLIDAY), F.col(S.IS_BUSINESS_DAY), supplied)
    return df.select(*KEYS, flag.alias("business_day_final"))


B26_SQL = Q.DEMAND_CAL + """
SELECT series_id, date,
  CAST(CASE WHEN is_holiday = 1 THEN 0
            WHEN day(date) % 3 = 1 THEN 1
            WHEN day(date) % 3 = 2 THEN 0
            ELSE is_business_day END AS INTEGER) AS business_day_final
FROM cal
"""


def b27_clip_prediction(spark, sf):
    """Clip a naive gas forecast (previous day's gas, scaled up 40 %) to [0, demand]."""
    df = fe.gas_lags(demand_cal(spark, sf))
    pred = F.col(S.GAS_LAG1) * 1.4 - 5000.0
    return df.select(*KEYS, sc.clip_prediction(pred, F.col(S.MAX_DEMAND)).alias("gas_pred"))


B27_SQL = Q.DEMAND_CAL + """
SELECT series_id, date,
  CASE WHEN p IS NULL THEN NULL ELSE greatest(0.0, least(p, max_demand)) END AS gas_pred
FROM (SELECT *, LAG(gas_demand, 1) OVER (PARTITION BY series_id ORDER BY date) * 1.4 - 5000.0 AS p
      FROM cal)
"""


def f8_gas_rate(spark, sf):
    """Gas rate from the last two gas observations of each series (C6 state)."""
    from loadcast.operators import lookup as lk
    state = lk.last_two_gas(demand(spark, sf))
    return state.select(S.SERIES, F.round(sc.gas_rate(F.col("last_gas"), F.col("prev_gas")), 9)
                        .alias("gas_rate"))


F8_SQL = Q.DEMAND + """
, ranked AS (
  SELECT series_id, gas_demand, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn
  FROM panel WHERE gas_demand IS NOT NULL AND solar_max IS NOT NULL
), st AS (
  SELECT series_id, MAX(CASE WHEN rn = 1 THEN gas_demand END) AS last_gas,
         MAX(CASE WHEN rn = 2 THEN gas_demand END) AS prev_gas
  FROM ranked WHERE rn <= 2 GROUP BY 1
)
SELECT series_id, ROUND(COALESCE((last_gas - prev_gas) / NULLIF(prev_gas, 0.0), 0.0), 9) AS gas_rate
FROM st
"""


# --- panel sources ----------------------------------------------------

def panel_lineitem_daily(spark, sf):
    """Dense panel: daily demand / solar / gas per return flag, with temperatures."""
    return demand(spark, sf)


PANEL_LINEITEM_SQL = Q.DEMAND + "SELECT * FROM panel\n"


def panel_orders_region(spark, sf):
    """Sparse panel: daily order totals per region (orders x customer x nation)."""
    from loadcast.sources import panels
    return panels.region_panel(spark, sf)


PANEL_REGION_SQL = Q.REGION + "SELECT * FROM panel\n"


def panel_events_peak(spark, sf):
    """Peak panel: the daily maximum event value per event type, with its lags."""
    from loadcast.sources import panels
    p = panels.peak_panel(spark, sf)
    return fe.demand_lags(p, by="calendar").select(*KEYS, S.MAX_DEMAND, S.TEMP_HIGH,
                                                   S.DEMAND_LAG1, S.DEMAND_LAG7)


PANEL_EVENTS_SQL = Q.EVENTS + """
SELECT series_id, date, max_demand, temp_high,
       LAG(max_demand, 1) OVER (PARTITION BY series_id ORDER BY date) AS demand_lag1,
       (SELECT MAX(q.max_demand) FROM panel q
        WHERE q.series_id = panel.series_id AND q.date = panel.date - 7) AS demand_lag7
FROM panel
"""


QUERIES = {
    "panel_lineitem_daily": (panel_lineitem_daily, PANEL_LINEITEM_SQL),
    "panel_orders_region": (panel_orders_region, PANEL_REGION_SQL),
    "panel_events_peak": (panel_events_peak, PANEL_EVENTS_SQL),
    "flagship_lag_error": (flagship_lag_error, FLAGSHIP_SQL),
    "b3_calendar_parts": (b3_calendar_parts, B3_SQL),
    "b4_weekday_name": (b4_weekday_name, B4_SQL),
    "b5_holiday_flag": (b5_holiday_flag, B5_SQL),
    "b5_lunar_holidays": (b5_lunar_holidays, B5_LUNAR_SQL),
    "b6_business_day": (b6_business_day, B6_SQL),
    "b7_day_type_default": (b7_day_type_default, B7_SQL),
    "b8_normalize_day_type": (b8_normalize_day_type, B8_SQL),
    "b9_one_hot": (b9_one_hot, B9_SQL),
    "b10_season_flags": (b10_season_flags, B10_SQL),
    "b11_cooling_intensity": (b11_cooling_intensity, B11_SQL),
    "b12_heating_intensity": (b12_heating_intensity, B12_SQL),
    "b13_diurnal_range": (b13_diurnal_range, B13_SQL),
    "b14_residual_load": (b14_residual_load, B14_SQL),
    "b15_demand_ratios": (b15_demand_ratios, B15_SQL),
    "b16_gas_budget": (b16_gas_budget, B16_SQL),
    "b17_fill_lags": (b17_fill_lags, B17_SQL),
    "b18_drop_essential_nulls": (b18_drop_essential_nulls, B18_SQL),
    "b19_complete_cases": (b19_complete_cases, B19_SQL),
    "b24_align_features": (b24_align_features, B24_SQL),
    "b25_fallback_temperatures": (b25_fallback_temperatures, B25_SQL),
    "b26_business_day_override": (b26_business_day_override, B26_SQL),
    "b27_clip_prediction": (b27_clip_prediction, B27_SQL),
    "f8_gas_rate": (f8_gas_rate, F8_SQL),
}
