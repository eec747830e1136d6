"""Registered queries for window, split and aggregate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.catalog import sqlparts as Q
from loadcast.catalog.common import demand, demand_cal, r6, region_cal
from loadcast.functions import calendar as cal
from loadcast.operators import features as fe
from loadcast.operators import lookup as lk
from loadcast.operators import metrics as me
from loadcast.operators import split as sp

KEYS = [S.SERIES, S.DATE]
W_SQL = "OVER (PARTITION BY series_id ORDER BY date)"


def c1_demand_lag1(spark, sf):
    df = region_cal(spark, sf)
    return df.select(*KEYS, fe.lag_by_rows(S.MAX_DEMAND, 1).alias(S.DEMAND_LAG1))


C1_SQL = Q.REGION_CAL + f"SELECT series_id, date, LAG(max_demand, 1) {W_SQL} AS demand_lag1 FROM cal\n"


def c2_demand_lag7(spark, sf):
    """Row lag (reference meaning) and calendar lag side by side on the sparse panel."""
    df = region_cal(spark, sf)
    return df.select(*KEYS, fe.lag_by_rows(S.MAX_DEMAND, 7).alias(S.DEMAND_LAG7),
                     fe.lag_by_calendar(S.MAX_DEMAND, 7).alias("demand_lag7_calendar"))


C2_SQL = Q.REGION_CAL + f"""
SELECT c.series_id, c.date, LAG(c.max_demand, 7) OVER (PARTITION BY c.series_id ORDER BY c.date) AS demand_lag7,
       p.max_demand AS demand_lag7_calendar
FROM cal c LEFT JOIN cal p ON p.series_id = c.series_id AND p.date = c.date - 7
"""

_GAS_HOLES = """CASE WHEN day(date) = 9 THEN NULL WHEN day(date) = 10 THEN 0.0
                     ELSE gas_demand END"""


def _gas_holes(df):
    dom = F.dayofmonth(S.DATE)
    return df.withColumn(S.GAS_DEMAND, F.when(dom == 9, F.lit(None).cast("double"))
                         .when(dom == 10, F.lit(0.0)).otherwise(F.col(S.GAS_DEMAND)))


def c3_gas_lag1(spark, sf):
    df = fe.gas_lags(_gas_holes(demand(spark, sf)))
    return df.select(*KEYS, S.GAS_LAG1)


C3_SQL = Q.DEMAND + f"""
SELECT series_id, date, LAG(gas, 1) {W_SQL} AS gas_lag1
FROM (SELECT *, {_GAS_HOLES} AS gas FROM panel)
"""


def c4_gas_change_lag1(spark, sf):
    df = fe.gas_lags(_gas_holes(demand(spark, sf)))
    return df.select(*KEYS, F.round(S.GAS_CHANGE_LAG1, 12).alias(S.GAS_CHANGE_LAG1))


C4_SQL = Q.DEMAND + f"""
, g AS (SELECT *, {_GAS_HOLES} AS gas FROM panel)
, f AS (SELECT *, LAST_VALUE(gas IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gf FROM g)
SELECT series_id, date,
  ROUND((LAG(gf, 1) {W_SQL} - LAG(gf, 2) {W_SQL}) / NULLIF(LAG(gf, 2) {W_SQL}, 0.0), 12) AS gas_change_lag1
FROM f
"""


def c5_tail_values(spark, sf):
    return lk.tail_values(region_cal(spark, sf), S.MAX_DEMAND, 14)


C5_SQL = Q.REGION + """
, r AS (SELECT series_id, date, max_demand,
               ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn,
               COUNT(*) OVER (PARTITION BY series_id) AS cnt
        FROM panel WHERE max_demand IS NOT NULL)
SELECT series_id, date, max_demand, CAST(LEAST(cnt, 14) - rn + 1 AS INTEGER) AS pos
FROM r WHERE rn <= 14
"""


def c6_last_two_gas(spark, sf):
    return lk.last_two_gas(_gas_holes(demand(spark, sf)))


C6_SQL = Q.DEMAND + f"""
, r AS (SELECT series_id, gas, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn
        FROM (SELECT *, {_GAS_HOLES} AS gas FROM panel) WHERE gas IS NOT NULL AND solar_max IS NOT NULL)
SELECT series_id, MAX(CASE WHEN rn = 1 THEN gas END) AS last_gas,
       MAX(CASE WHEN rn = 2 THEN gas END) AS prev_gas
FROM r WHERE rn <= 2 GROUP BY 1
"""


def c7_chronological_split(spark, sf):
    return sp.chronological_split(region_cal(spark, sf)).select(*KEYS, "split")


C7_SQL = Q.REGION + f"""
SELECT series_id, date,
  CASE WHEN ROW_NUMBER() {W_SQL} <= GREATEST(1, LEAST(FLOOR(COUNT(*) OVER (PARTITION BY series_id) * 0.8::DOUBLE),
                                                COUNT(*) OVER (PARTITION BY series_id) - 1))
       THEN 'train' ELSE 'test' END AS split
FROM panel
"""


def c8_expanding_folds(spark, sf):
    return sp.expanding_folds(region_cal(spark, sf)).select(*KEYS, "fold", "role")


def c7_split_rank(spark, sf):
    """The same split from distributed positions instead of a window per series."""
    return sp.chronological_split(region_cal(spark, sf), method="rank").select(*KEYS, "split")


def c8_folds_rank(spark, sf):
    return sp.expanding_folds(region_cal(spark, sf), method="rank").select(*KEYS, "fold", "role")


C8_SQL = Q.REGION + f"""
, b AS (SELECT series_id, date, ROW_NUMBER() {W_SQL} - 1 AS rn,
               COUNT(*) OVER (PARTITION BY series_id) AS n,
               COUNT(*) OVER (PARTITION BY series_id) // 4 AS blk FROM panel)
, f AS (SELECT b.*, fold, n - (3 - fold) * blk AS st FROM b, (SELECT UNNEST([0, 1, 2]) AS fold))
SELECT series_id, date, CAST(fold AS INTEGER) AS fold,
       CASE WHEN rn < st THEN 'train' ELSE 'test' END AS role
FROM f WHERE blk > 0 AND rn < st + blk
"""


def c8_fold_blocks(spark, sf):
    """Every row once with its test block, from the small table of bounds."""
    return sp.fold_blocks(region_cal(spark, sf), method="dates").select(*KEYS, "block")


def c8_fold_bounds(spark, sf):
    bounds = sp.fold_bounds(region_cal(spark, sf))
    return bounds.select("series_id", F.posexplode("starts").alias("fold", "test_start"))


C8_BLOCKS_CTE = Q.REGION + f"""
, b AS (SELECT series_id, date, ROW_NUMBER() {W_SQL} - 1 AS rn,
               COUNT(*) OVER (PARTITION BY series_id) AS n,
               COUNT(*) OVER (PARTITION BY series_id) // 4 AS blk FROM panel)
, k AS (SELECT series_id, date, CASE WHEN rn < n - 3 * blk THEN -1 ELSE (rn - n + 3 * blk) // blk END AS block
        FROM b WHERE blk > 0)
"""
C8_BLOCKS_SQL = C8_BLOCKS_CTE + "SELECT series_id, date, CAST(block AS INTEGER) AS block FROM k\n"
C8_BOUNDS_SQL = C8_BLOCKS_CTE + """SELECT series_id, CAST(block AS INTEGER) AS fold, MIN(date) AS test_start
FROM k WHERE block >= 0 GROUP BY ALL
"""


def c9_ranked_importances(spark, sf):
    """Top-2 features per series by |corr(feature, demand)| as the importance."""
    df = demand_cal(spark, sf)
    feats = [S.TEMP_HIGH, S.TEMP_LOW, S.FEELS_LIKE, S.SOLAR_MAX, S.GAS_DEMAND, S.MONTH]
    scores = df.groupBy(S.SERIES).agg(*[
        F.abs(F.corr(F.col(c).cast("double"), F.col(S.MAX_DEMAND))).alias(c) for c in feats])
    long = scores.select(S.SERIES, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in feats
    ])).alias("_kv")).select(S.SERIES, "_kv.feature", F.round("_kv.importance", 6).alias("importance"))
    return me.top_k(long, "importance", 2, keys=[S.SERIES], tiebreak="feature").select(
        S.SERIES, F.col("rank").cast("int").alias("rank"), "feature", "importance")


_C9_FEATS = ["temp_high", "temp_low", "feels_like", "solar_max", "gas_demand", "month"]
C9_SQL = Q.DEMAND_CAL + """
, s AS (
""" + "\nUNION ALL\n".join(
    f"  SELECT series_id, '{c}' AS feature, ROUND(ABS(CORR(CAST({c} AS DOUBLE), max_demand)), 6) AS importance FROM cal GROUP BY 1"
    for c in _C9_FEATS) + """
)
SELECT series_id, CAST(rank AS INTEGER) AS rank, feature, importance FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY importance DESC, feature) AS rank FROM s)
WHERE rank <= 2
"""


def c10_preview(spark, sf):
    df = fe.demand_lags(demand_cal(spark, sf))
    return me.preview(df.select(*KEYS, S.MAX_DEMAND, S.DEMAND_LAG1), 10)


C10_SQL = Q.DEMAND_LAGS + """
SELECT series_id, date, max_demand, demand_lag1 FROM lagged ORDER BY series_id, date LIMIT 10
"""


# --- aggregates ---------------------------------------------------------------------

def d1_month_weekday_mean(spark, sf):
    t = fe.month_weekday_table(demand_cal(spark, sf))
    return t.select(S.SERIES, S.YEAR, S.MONTH, S.WEEKDAY_NUM,
                    r6(F.col("mean_max_demand")).alias("mean_max_demand"), "n_days")


D1_SQL = Q.DEMAND_CAL + """
SELECT series_id, year, month, weekday_num, ROUND(AVG(max_demand), 6) AS mean_max_demand,
       COUNT(max_demand) AS n_days
FROM cal GROUP BY 1, 2, 3, 4
"""


def e1_demand_last_year_dow(spark, sf):
    """Per-row prior-year (month, weekday) mean: the default ``per_row`` mode."""
    df = fe.last_year_dow_mean(demand_cal(spark, sf), mode="per_row")
    return df.select(*KEYS, r6(F.col(S.DEMAND_LAST_YEAR_DOW)).alias(S.DEMAND_LAST_YEAR_DOW))


E1_SQL = Q.DEMAND_CAL + """
, m AS (SELECT series_id, year, month, weekday_num, AVG(max_demand) AS mm FROM cal GROUP BY 1, 2, 3, 4)
SELECT c.series_id, c.date, ROUND(COALESCE(m.mm, 0.0), 6) AS demand_last_year_dow
FROM cal c LEFT JOIN m ON m.series_id = c.series_id AND m.year = c.year - 1
  AND m.month = c.month AND m.weekday_num = c.weekday_num
"""


def e1_demand_last_year_dow_fixed(spark, sf):
    """The reference's rule: one prior year (latest - 1) for all rows."""
    df = fe.last_year_dow_mean(region_cal(spark, sf), mode="fixed")
    return df.select(*KEYS, r6(F.col(S.DEMAND_LAST_YEAR_DOW)).alias(S.DEMAND_LAST_YEAR_DOW))


E1F_SQL = Q.REGION_CAL + """
, t AS (SELECT series_id, MAX(year) - 1 AS ty FROM cal GROUP BY 1)
, h AS (SELECT t.series_id, t.ty, COUNT(c.date) AS k FROM t LEFT JOIN cal c
          ON c.series_id = t.series_id AND c.year = t.ty GROUP BY 1, 2)
, m AS (SELECT c.series_id, c.month, c.weekday_num, AVG(c.max_demand) AS mm
        FROM cal c JOIN h ON h.series_id = c.series_id
        WHERE h.k = 0 OR c.year = h.ty GROUP BY 1, 2, 3)
SELECT c.series_id, c.date, ROUND(COALESCE(m.mm, 0.0), 6) AS demand_last_year_dow
FROM cal c LEFT JOIN m ON m.series_id = c.series_id AND m.month = c.month
  AND m.weekday_num = c.weekday_num
"""


def d2_total_ratio_means(spark, sf):
    t = fe.ratio_means_table(demand_cal(spark, sf))
    return t.select(S.SERIES, *[F.round(c, 9).alias(c) for c in
                                ("ratio_business", "ratio_other", "ratio_overall")])


D2_SQL = Q.DEMAND_CAL + """
, r AS (SELECT *, (gas_demand + solar_max) / NULLIF(max_demand, 0.0) AS ratio FROM cal)
SELECT series_id,
  ROUND(COALESCE(AVG(CASE WHEN is_business_day = 1 THEN ratio END), AVG(ratio), 0.0), 9) AS ratio_business,
  ROUND(COALESCE(AVG(CASE WHEN is_business_day = 0 THEN ratio END), AVG(ratio), 0.0), 9) AS ratio_other,
  ROUND(COALESCE(AVG(ratio), 0.0), 9) AS ratio_overall
FROM r GROUP BY 1
"""


def _holdout(spark, sf):
    df = fe.demand_lags(demand_cal(spark, sf)).na.drop(subset=[S.DEMAND_LAG7])
    return sp.chronological_split(df).where(F.col("split") == "test")


_HOLDOUT_SQL = Q.DEMAND_LAGS + f"""
, cc AS (SELECT * FROM lagged WHERE demand_lag7 IS NOT NULL)
, s AS (SELECT *, ROW_NUMBER() {W_SQL} AS rn, COUNT(*) OVER (PARTITION BY series_id) AS n FROM cc)
, ho AS (SELECT * FROM s WHERE rn > GREATEST(1, LEAST(FLOOR(n * 0.8::DOUBLE), n - 1)))
"""


def d6_mae(spark, sf):
    """Hold-out MAE of the 7-rows-back baseline forecast per series."""
    m = me.regression_metrics(_holdout(spark, sf), S.MAX_DEMAND, S.DEMAND_LAG7)
    return m.select(S.SERIES, "n", r6(F.col("mae")).alias("mae"))


D6_SQL = _HOLDOUT_SQL + """
SELECT series_id, COUNT(*) AS n,
  ROUND(CAST(SUM(ABS(CAST(max_demand AS DECIMAL(18,2)) - CAST(demand_lag7 AS DECIMAL(18,2)))) AS DOUBLE) / COUNT(*), 6) AS mae
FROM ho GROUP BY 1
"""


def d7_r2(spark, sf):
    m = me.regression_metrics(_holdout(spark, sf), S.MAX_DEMAND, S.DEMAND_LAG7)
    return m.select(S.SERIES, "n", r6(F.col("r2")).alias("r2"))


D7_SQL = _HOLDOUT_SQL + """
, a AS (SELECT series_id, COUNT(*) AS n,
          CAST(SUM((CAST(max_demand AS DECIMAL(18,2)) - CAST(demand_lag7 AS DECIMAL(18,2)))
                 * (CAST(max_demand AS DECIMAL(18,2)) - CAST(demand_lag7 AS DECIMAL(18,2)))) AS DOUBLE) AS ssr,
          CAST(SUM(CAST(max_demand AS DECIMAL(18,2))) AS DOUBLE) AS sy,
          CAST(SUM(CAST(max_demand AS DECIMAL(18,2)) * CAST(max_demand AS DECIMAL(18,2))) AS DOUBLE) AS syy
        FROM ho GROUP BY 1)
SELECT series_id, n, ROUND(CASE WHEN syy - sy * sy / n > 0 THEN 1.0 - ssr / (syy - sy * sy / n)
                                WHEN ssr = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2
FROM a
"""


def b28_confidence_score(spark, sf):
    """Confidence of the 7-rows-back baseline per series from its hold-out R2."""
    from loadcast.functions import scalars as sc
    m = me.regression_metrics(_holdout(spark, sf), S.MAX_DEMAND, S.DEMAND_LAG7)
    return m.select(S.SERIES, r6(sc.confidence_score(F.col("r2"))).alias("confidence"))


B28_SQL = _HOLDOUT_SQL + """
, a AS (SELECT series_id, COUNT(*) AS n,
          CAST(SUM((CAST(max_demand AS DECIMAL(18,2)) - CAST(demand_lag7 AS DECIMAL(18,2)))
                 * (CAST(max_demand AS DECIMAL(18,2)) - CAST(demand_lag7 AS DECIMAL(18,2)))) AS DOUBLE) AS ssr,
          CAST(SUM(CAST(max_demand AS DECIMAL(18,2))) AS DOUBLE) AS sy,
          CAST(SUM(CAST(max_demand AS DECIMAL(18,2)) * CAST(max_demand AS DECIMAL(18,2))) AS DOUBLE) AS syy
        FROM ho GROUP BY 1)
, r AS (SELECT series_id, CASE WHEN syy - sy * sy / n > 0 THEN 1.0 - ssr / (syy - sy * sy / n)
                               WHEN ssr = 0 THEN 1.0 ELSE 0.0 END AS r2 FROM a)
SELECT series_id, ROUND(LEAST(95.0, GREATEST(60.0, r2 * 100.0)), 6) AS confidence FROM r
"""


def b20_cutoff_filter(spark, sf):
    return sp.cutoff_filter(demand(spark, sf), "1999-06-01").select(*KEYS, S.GAS_DEMAND)


B20_SQL = Q.DEMAND + "SELECT series_id, date, gas_demand FROM panel WHERE date >= DATE '1999-06-01'\n"


def b21_split_by_day_kind(spark, sf):
    df = sp.split_by_day_kind(region_cal(spark, sf), min_rows=20)
    return df.select(*KEYS, "segment", "split")


B21_SQL = Q.REGION_CAL + """
, g AS (SELECT *, SUM(is_business_day) OVER (PARTITION BY series_id) AS nb,
               SUM(1 - is_business_day) OVER (PARTITION BY series_id) AS no,
               CASE WHEN is_business_day = 1 THEN 'business' ELSE 'other' END AS segment FROM cal)
, s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id, segment ORDER BY date) AS rn,
               COUNT(*) OVER (PARTITION BY series_id, segment) AS n FROM g WHERE nb >= 20 AND no >= 20)
SELECT series_id, date, segment,
  CASE WHEN rn <= GREATEST(1, LEAST(FLOOR(n * 0.8::DOUBLE), n - 1)) THEN 'train' ELSE 'test' END AS split
FROM s
"""


QUERIES = {
    "c1_demand_lag1": (c1_demand_lag1, C1_SQL),
    "c2_demand_lag7": (c2_demand_lag7, C2_SQL),
    "c3_gas_lag1": (c3_gas_lag1, C3_SQL),
    "c4_gas_change_lag1": (c4_gas_change_lag1, C4_SQL),
    "c5_tail_values": (c5_tail_values, C5_SQL),
    "c6_last_two_gas": (c6_last_two_gas, C6_SQL),
    "c7_chronological_split": (c7_chronological_split, C7_SQL),
    "c8_expanding_folds": (c8_expanding_folds, C8_SQL),
    "c8_fold_blocks": (c8_fold_blocks, C8_BLOCKS_SQL),
    "c8_fold_bounds": (c8_fold_bounds, C8_BOUNDS_SQL),
    "c7_split_rank": (c7_split_rank, C7_SQL),
    "c8_folds_rank": (c8_folds_rank, C8_SQL),
    "c9_ranked_importances": (c9_ranked_importances, C9_SQL),
    "c10_preview": (c10_preview, C10_SQL),
    "d1_month_weekday_mean": (d1_month_weekday_mean, D1_SQL),
    "e1_demand_last_year_dow": (e1_demand_last_year_dow, E1_SQL),
    "e1_demand_last_year_dow_fixed": (e1_demand_last_year_dow_fixed, E1F_SQL),
    "d2_total_ratio_means": (d2_total_ratio_means, D2_SQL),
    "d6_mae": (d6_mae, D6_SQL),
    "d7_r2": (d7_r2, D7_SQL),
    "b20_cutoff_filter": (b20_cutoff_filter, B20_SQL),
    "b28_confidence_score": (b28_confidence_score, B28_SQL),
    "b21_split_by_day_kind": (b21_split_by_day_kind, B21_SQL),
}
