"""Registered queries of kept state: brought up to date from a change set (C6, D1, D2), and
forecasts from it (F5, F7).

The edited panel follows from the demand panel by fixed rules on the day of
the year: days ``% 37 = 5`` go, days ``% 23 = 4`` get 100 more demand and 10
more gas, and every series gets its last day again, 400 days later.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.catalog import model_queries as mq
from loadcast.catalog import sqlparts as Q
from loadcast.catalog.common import r6
from loadcast.operators import changes as ch
from loadcast.operators import lookup as lk
from loadcast.operators import state as st
from loadcast.plans import forecast as fc
from loadcast.plans import scoring
from loadcast.plans import training as tr
from loadcast.session import scratch_path

VALUES = [S.MAX_DEMAND, S.GAS_DEMAND, S.SOLAR_MAX]
HORIZON = 14
_CACHE: dict = {}


def edited(panel):
    day = F.dayofyear(S.DATE)
    more = day % 23 == 4
    kept = panel.where(day % 37 != 5).withColumns({
        S.MAX_DEMAND: F.when(more, F.col(S.MAX_DEMAND) + 100).otherwise(F.col(S.MAX_DEMAND)),
        S.GAS_DEMAND: F.when(more, F.col(S.GAS_DEMAND) + 10).otherwise(F.col(S.GAS_DEMAND))})
    last = panel.groupBy(S.SERIES).agg(*[F.max_by(c, S.DATE).alias(c) for c in VALUES],
                                       F.date_add(F.max(S.DATE), 400).alias(S.DATE))
    return kept.unionByName(last.select(S.SERIES, S.DATE, *VALUES))


EDITED_SQL = Q.with_ctes(Q.LINEITEM_PANEL, Q.temps("lineitem_panel", "panel"), """
edited AS (
  SELECT series_id, date, max_demand + CASE WHEN dayofyear(date) % 23 = 4 THEN 100 ELSE 0 END AS max_demand,
         gas_demand + CASE WHEN dayofyear(date) % 23 = 4 THEN 10 ELSE 0 END AS gas_demand, solar_max
  FROM panel WHERE dayofyear(date) % 37 <> 5
  UNION ALL
  SELECT series_id, CAST(MAX(date) + 400 AS DATE), arg_max(max_demand, date), arg_max(gas_demand, date),
         arg_max(solar_max, date) FROM panel GROUP BY 1)""", Q.calendar("edited", "cal"))


def updated_state(spark, sf):
    """State of the panel, then updated by the change set of the edited panel; its folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CACHE:
        before, after = scratch_path(spark, "state"), scratch_path(spark, "state")
        old = mq.panel(spark, sf).select(S.SERIES, S.DATE, *VALUES)
        new = tr.materialize(edited(old))
        changes = ch.changed_rows(new, old, [S.SERIES, S.DATE]).where(F.col("kind") != ch.SAME)
        scoring.save_state(old, before)
        scoring.update_state(spark, before, after, changes, old, new)
        _CACHE[key] = after
    return _CACHE[key]


def d1_state_after_changes(spark, sf):
    t = st.month_weekday_means(spark.read.parquet(updated_state(spark, sf) + "/month_weekday"))
    return t.select(*st.MONTH_WEEKDAY.keys, r6(F.col("mean_max_demand")).alias("mean_max_demand"), "n_days")


D1_STATE_SQL = EDITED_SQL + """
SELECT series_id, year, month, weekday_num, ROUND(AVG(max_demand), 6) AS mean_max_demand,
       COUNT(max_demand) AS n_days
FROM cal GROUP BY 1, 2, 3, 4
"""


def d2_state_after_changes(spark, sf):
    t = st.ratio_means(spark.read.parquet(updated_state(spark, sf) + "/day_kind"))
    return t.select(S.SERIES, *[F.round(c, 9).alias(c) for c in t.columns if c != S.SERIES])


D2_STATE_SQL = EDITED_SQL + """
, r AS (SELECT *, (gas_demand + solar_max) / NULLIF(max_demand, 0.0) AS ratio FROM cal)
SELECT series_id,
  ROUND(COALESCE(AVG(CASE WHEN is_business_day = 1 THEN ratio END), AVG(ratio), 0.0), 9) AS ratio_business,
  ROUND(COALESCE(AVG(CASE WHEN is_business_day = 0 THEN ratio END), AVG(ratio), 0.0), 9) AS ratio_other,
  ROUND(COALESCE(AVG(ratio), 0.0), 9) AS ratio_overall
FROM r GROUP BY 1
"""


def c6_state_after_changes(spark, sf):
    t = lk.last_two_gas(spark.read.parquet(updated_state(spark, sf) + "/recent"))
    return t.select(S.SERIES, r6(F.col("last_gas")).alias("last_gas"), r6(F.col("prev_gas")).alias("prev_gas"))


C6_STATE_SQL = EDITED_SQL + """
, r AS (SELECT series_id, gas_demand AS gas, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn
        FROM edited WHERE gas_demand IS NOT NULL AND solar_max IS NOT NULL)
SELECT series_id, ROUND(MAX(CASE WHEN rn = 1 THEN gas END), 6) AS last_gas,
       ROUND(MAX(CASE WHEN rn = 2 THEN gas END), 6) AS prev_gas
FROM r WHERE rn <= 2 GROUP BY 1
"""


def _kept(spark, sf):
    """Folder with the models and the state of the whole panel; both fits and the state need only the panel
    and run side by side."""
    key = (spark.sparkContext.applicationId, sf, "kept")
    if key not in _CACHE:
        path, hist = scratch_path(spark, "kept"), mq.panel(spark, sf)
        with ThreadPoolExecutor(max_workers=3) as pool:
            demand = pool.submit(mq.trained_demand, spark, sf)
            gas = pool.submit(mq.trained_trees, spark, sf)
            state = pool.submit(scoring.save_state, hist, path)
        state.result()
        scoring.save_models(path, demand.result(), gas.result())
        _CACHE[key] = path
    return _CACHE[key]


def _coming_days(hist):
    last = hist.groupBy(S.SERIES).agg(F.max(S.DATE).alias("_last"))
    days = F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", HORIZON)))
    return last.select(S.SERIES, days.alias(S.DATE))


def f5_score_from_state(spark, sf):
    """The coming two weeks of every series from kept model and state, held against the forecast from
    the trained model and the whole history: predictions equal up to the last digits of the means."""
    path, hist = _kept(spark, sf), mq.panel(spark, sf)
    days = _coming_days(hist)
    t = mq.trained_demand(spark, sf)
    # Planning ships every sub-forest to the executors: the kept model's and the trained one's at once.
    with ThreadPoolExecutor(max_workers=2) as pool:
        lean = pool.submit(scoring.score_demand, spark, path, path, days)
        full = pool.submit(fc.forecast_demand, days, hist, t.model, t.features)
    lean = lean.result()
    full = full.result().select(S.SERIES, S.DATE, F.col("prediction").alias("_full"))
    same = F.abs(F.col("prediction") - F.col("_full")) <= 1e-9 * F.abs(F.col("_full"))
    return lean.join(full, [S.SERIES, S.DATE]).select(S.SERIES, S.DATE, "demand_last_week", same.alias("same"))


F5_STATE_SQL = Q.DEMAND + f"""
, t AS (SELECT series_id, CAST(m + CAST(i AS INTEGER) AS DATE) AS date
        FROM (SELECT series_id, MAX(date) AS m FROM panel GROUP BY 1), range(1, {HORIZON + 1}) g(i))
, h AS (SELECT series_id, date, max_demand, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date DESC) AS pos
        FROM panel WHERE max_demand IS NOT NULL)
SELECT t.series_id, t.date, COALESCE(e.max_demand, f.max_demand, 0.0) AS demand_last_week, TRUE AS same
FROM t LEFT JOIN h e ON e.series_id = t.series_id AND e.date = t.date - 7
       LEFT JOIN h f ON f.series_id = t.series_id AND f.pos = 7
"""


def f7_score_from_state(spark, sf):
    """Gas for the coming two weeks, each with the demand and solar of 14 days before as its scenario."""
    path, hist = _kept(spark, sf), mq.panel(spark, sf)
    scen = hist.select(S.SERIES, F.date_add(S.DATE, HORIZON).alias(S.DATE), S.MAX_DEMAND, S.SOLAR_MAX)
    scen = scen.join(_coming_days(hist), [S.SERIES, S.DATE], "left_semi")
    t = mq.trained_trees(spark, sf)
    lean = scoring.score_gas(spark, path, path, scen)
    full = fc.forecast_gas(scen, hist, t.model, t.features, ratios=t.ratios).select(
        S.SERIES, S.DATE, F.col("gas_prediction").alias("_full"))
    same = F.abs(F.col("gas_prediction") - F.col("_full")) <= 1e-9 * F.abs(F.col("_full"))
    return lean.join(full, [S.SERIES, S.DATE]).select(
        S.SERIES, S.DATE, S.MAX_DEMAND, F.round(S.SOLAR_MAX, 4).alias(S.SOLAR_MAX), same.alias("same"))


F7_STATE_SQL = Q.DEMAND + f"""
SELECT series_id, CAST(date + {HORIZON} AS DATE) AS date, max_demand, ROUND(solar_max, 4) AS solar_max, TRUE AS same
FROM panel JOIN (SELECT series_id, MAX(date) AS m FROM panel GROUP BY 1) USING (series_id)
WHERE date + {HORIZON} > m
"""


QUERIES = {
    "c6_state_after_changes": (c6_state_after_changes, C6_STATE_SQL),
    "d1_state_after_changes": (d1_state_after_changes, D1_STATE_SQL),
    "d2_state_after_changes": (d2_state_after_changes, D2_STATE_SQL),
    "f5_score_from_state": (f5_score_from_state, F5_STATE_SQL),
    "f7_score_from_state": (f7_score_from_state, F7_STATE_SQL),
}
