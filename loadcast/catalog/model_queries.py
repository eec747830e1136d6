"""Registered queries for models and forecasts.

A prediction itself has no SQL twin. The queries return what a twin can
check: the exact rows that are predicted, their actual values, and the
properties a prediction must have (within the range of the training labels
for a forest, ``0 <= gas <= demand``, directions kept, shares summing to 1).
Trained models are kept per (application, sf) in this process, so several
queries share one fit.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcast import schema as S
from loadcast.catalog import sqlparts as Q
from loadcast.catalog.common import demand, region_cal
from loadcast.catalog.lookup_queries import TARGETS_SQL, calendar_targets
from loadcast.functions import calendar as cal
from loadcast.operators import features as fe
from loadcast.operators import lookup as lk
from loadcast.operators import split as sp
from loadcast.plans import forecast as fc
from loadcast.plans import models as md
from loadcast.plans import training as tr

_CACHE: dict = {}


def _key(spark, sf, kind):
    return (spark.sparkContext.applicationId, sf, kind)


def panel(spark, sf):
    """The demand panel, written once: it is much smaller than the table it sums up, and read many times."""
    k = _key(spark, sf, "panel")
    if k not in _CACHE:
        _CACHE[k] = tr.materialize(demand(spark, sf))
    return _CACHE[k]


def trained_demand(spark, sf):
    k = _key(spark, sf, "demand")
    if k not in _CACHE:
        _CACHE[k] = tr.train_demand(panel(spark, sf))
    return _CACHE[k]


def trained_gas(spark, sf):
    k = _key(spark, sf, "gas")
    if k not in _CACHE:
        _CACHE[k] = tr.train_gas(panel(spark, sf))
    return _CACHE[k]


def _train_mean(t):
    return F.lit(t.table.where(F.col("split") == sp.TRAIN).agg(F.avg(t.label)).first()[0])


def trained_trees(spark, sf):
    """The gas model as monotone trees, over the training table of the additive one."""
    k = _key(spark, sf, "trees")
    if k not in _CACHE:
        t = trained_gas(spark, sf)
        model = md.fit_gas_model(t.table.where(F.col("split") == sp.TRAIN), t.features, interactions=True,
                                 max_depth=4, learning_rate=0.2)
        _CACHE[k] = replace(t, model=model)
    return _CACHE[k]


def tuned_demand(spark, sf):
    k = _key(spark, sf, "tuned")
    if k not in _CACHE:
        table, features = tr.demand_training_table(panel(spark, sf))
        table = tr.materialize(table)
        _CACHE[k] = md.tune_forest(table.where(F.col("split") == sp.TRAIN), features, refit=False)
    return _CACHE[k]


def f1_fit_demand_forest(spark, sf):
    """Hold-out rows with their actual demand; a forest predicts means of training labels."""
    t = trained_demand(spark, sf)
    low, high = t.table.where(F.col("split") == sp.TRAIN).agg(
        F.min(t.label), F.max(t.label)).first()
    return tr.holdout_predictions(t).select(
        S.SERIES, S.DATE, "actual",
        F.col("prediction").between(low - 1e-6, high + 1e-6).alias("in_label_range"))


# Complete cases of the demand features: rows with a temperature (the lags are filled).
_DEMAND_ROWS = Q.DEMAND + """
, cc AS (SELECT * FROM panel WHERE temp_high IS NOT NULL AND temp_low IS NOT NULL AND feels_like IS NOT NULL
           AND max_demand IS NOT NULL)
, s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS rn,
               COUNT(*) OVER (PARTITION BY series_id) AS n FROM cc)
, ho AS (SELECT * FROM s WHERE rn > GREATEST(1, LEAST(FLOOR(n * 0.8::DOUBLE), n - 1)))
"""
_GAS_ROWS = Q.DEMAND + """
, s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS rn,
               COUNT(*) OVER (PARTITION BY series_id) AS n
        FROM panel WHERE gas_demand IS NOT NULL AND max_demand IS NOT NULL)
, ho AS (SELECT * FROM s WHERE rn > GREATEST(1, LEAST(FLOOR(n * 0.8::DOUBLE), n - 1)))
"""
F1_SQL = _DEMAND_ROWS + "SELECT series_id, date, max_demand AS actual, TRUE AS in_label_range FROM ho\n"


def f2_tune_forest(spark, sf):
    """Random search over expanding folds; one row per draw, the best of them chosen."""
    res = tuned_demand(spark, sf)
    best = min(t["mean_mae"] for t in res.trials)
    schema = T.StructType([
        T.StructField("draw", T.IntegerType()), T.StructField("num_trees", T.IntegerType()),
        T.StructField("max_depth", T.IntegerType()),
        T.StructField("min_rows_per_leaf", T.IntegerType()),
        T.StructField("scored", T.BooleanType()), T.StructField("best_is_chosen", T.BooleanType())])
    rows = [(t["draw"], t["numTrees"], t["maxDepth"] or md.UNLIMITED_DEPTH,
             t["minInstancesPerNode"], 0 < t["mean_mae"] < float("inf"),
             all(t[k] == res.best_params[k] for k in md.FOREST_GRID) == (t["mean_mae"] == best))
            for t in res.trials]
    return spark.createDataFrame(rows, schema)


F2_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {p['numTrees']}, {p['maxDepth'] or md.UNLIMITED_DEPTH}, {p['minInstancesPerNode']}, TRUE, TRUE)"
    for i, p in enumerate(md.sample_grid())) + \
    ") t(draw, num_trees, max_depth, min_rows_per_leaf, scored, best_is_chosen)\n"


def f2_tuning_errors(spark, sf):
    """The mean MAE over the time folds of every draw, and its rank (no twin: a model's result)."""
    trials = sorted(tuned_demand(spark, sf).trials, key=lambda t: (t["mean_mae"], t["draw"]))
    rows = [(t["draw"], t["numTrees"], t["maxDepth"] or md.UNLIMITED_DEPTH, t["minInstancesPerNode"],
             float(t["mean_mae"]), i) for i, t in enumerate(trials, 1)]
    return spark.createDataFrame(rows, "draw int, num_trees int, max_depth int, min_rows_per_leaf int, "
                                       "mean_mae double, rank int")


def f3_fit_gas_model(spark, sf):
    """Hold-out rows of the gas model with their actual values."""
    return tr.holdout_predictions(trained_gas(spark, sf)).select(
        S.SERIES, S.DATE, F.round("actual", 4).alias("actual"),
        (F.col("prediction").isNotNull() & ~F.isnan("prediction")).alias("predicted"))


F3_SQL = _GAS_ROWS + "SELECT series_id, date, ROUND(gas_demand, 4) AS actual, TRUE AS predicted FROM ho\n"


def f3_gas_trees(spark, sf):
    """The gas model with interactions, over rows of which some lack a feature."""
    t = trained_gas(spark, sf)
    holes = F.when(F.dayofmonth(S.DATE) % 10 != 3, F.col(S.GAS_LAG1))
    table = t.table.withColumn(S.GAS_LAG1, holes)
    model = md.fit_gas_model(table.where(F.col("split") == sp.TRAIN), t.features, monotone=False,
                             rounds=20, max_depth=4)
    pred = md.predict(model, table.where(F.col("split") == sp.TEST), t.features)
    return pred.select(S.SERIES, S.DATE, F.col(S.GAS_LAG1).isNull().alias("lacks_lag"),
                       (F.col("prediction").isNotNull() & ~F.isnan("prediction")).alias("predicted"))


F3_TREES_SQL = _GAS_ROWS + """SELECT series_id, date, day(date) % 10 = 3 AS lacks_lag, TRUE AS predicted FROM ho
"""


def f3_monotone_trees(spark, sf):
    """Hold-out rows of the monotone trees with their actual values; per series, whether the trees'
    MAE is no worse than that of the training mean."""
    t = trained_trees(spark, sf)
    scored = tr.holdout_predictions(t)
    better = scored.groupBy(S.SERIES).agg(
        (F.avg(F.abs(F.col("actual") - F.col("prediction")))
         <= F.avg(F.abs(F.col("actual") - _train_mean(t)))).alias("no_worse_than_mean"))
    return scored.join(better, S.SERIES).select(S.SERIES, S.DATE, F.round("actual", 4).alias("actual"),
                                                "no_worse_than_mean")


F3_MONOTONE_SQL = _GAS_ROWS + """SELECT series_id, date, ROUND(gas_demand, 4) AS actual, TRUE AS no_worse_than_mean FROM ho
"""
GRID_POINTS = 6


def f4_monotone_trees(spark, sf):
    """Every hold-out row with each signed feature moved over a grid of its cut points, the other
    features as they are: steps against the direction, and steps compared. The grid of a row and
    feature has ``GRID_POINTS`` points; predictions are made once, over all of them."""
    t = trained_trees(spark, sf)
    model, signed = t.model, [(f, s) for f, s in zip(t.features, t.model.signs) if s]
    points = []
    for f, sign in signed:
        edges = model.edges[t.features.index(f)]
        points += [F.struct(F.lit(f).alias("feature"), F.lit(sign).alias("sign"), F.lit(k).alias("point"),
                            F.lit(float(edges[k * (len(edges) - 1) // (GRID_POINTS - 1)])).alias("x"))
                   for k in range(GRID_POINTS)]
    grid = (t.table.where(F.col("split") == sp.TEST)
            .select(S.SERIES, S.DATE, *t.features, F.explode(F.array(*points)).alias("_g")))
    moved = {f: F.when(F.col("_g.feature") == f, F.col("_g.x")).otherwise(F.col(f)) for f, _ in signed}
    scored = model.transform(grid, overrides=moved)
    line = F.sort_array(F.collect_list(F.struct("_g.point", "prediction")))["prediction"]
    lines = scored.groupBy(S.SERIES, S.DATE, "_g.feature", "_g.sign").agg(line.alias("p"))
    steps = F.zip_with(F.slice("p", 1, GRID_POINTS - 1), F.slice("p", 2, GRID_POINTS - 1),
                       lambda a, b: (b - a) * F.col("sign"))
    return lines.groupBy("feature", "sign").agg(
        F.sum(F.size(steps)).alias("n_steps"),
        F.sum(F.size(F.filter(steps, lambda d: d < -1e-9))).alias("n_violations"))


F4_TREES_SQL = _GAS_ROWS + f"""SELECT feature, CAST(sign AS INTEGER) AS sign, COUNT(*) * {GRID_POINTS - 1} AS n_steps, 0::BIGINT AS n_violations
FROM ho, (VALUES """ + ", ".join(f"('{f}', {d})" for f, d in S.GAS_MONOTONE.items() if d) \
    + ") v(feature, sign) GROUP BY 1, 2\n"


def f4_monotone_map(spark, sf):
    """Property check: raising a signed feature never moves the prediction the
    wrong way, over every hold-out row (base and raised predictions are
    computed side by side in one projection)."""
    t = trained_gas(spark, sf)
    test = t.table.where(F.col("split") == sp.TEST)
    signs = md.monotone_signs(t.features)
    model = t.model
    signed = [(f, s) for f, s in zip(t.features, signs) if s != 0]
    scored = model.transform(test, out="_base")
    checks = []
    for i, (f, sign) in enumerate(signed):
        raised = F.col(f) + F.abs(F.col(f)) * 0.1 + 1.0
        scored = model.transform(scored, out=f"_up{i}", overrides={f: raised}, prefix=f"_u{i}_")
        checks.append(F.struct(F.lit(f).alias("feature"), F.lit(sign).alias("sign"),
                               ((F.col(f"_up{i}") - F.col("_base")) * sign < -1e-9)
                               .cast("int").alias("bad")))
    long = scored.select(F.explode(F.array(*checks)).alias("_r")).select("_r.*")
    return long.groupBy("feature", "sign").agg(F.count(F.lit(1)).alias("n_rows"),
                                               F.sum("bad").alias("n_violations"))


F4_SQL = _GAS_ROWS + "SELECT feature, CAST(sign AS INTEGER) AS sign, COUNT(*) AS n_rows, 0::BIGINT AS n_violations\nFROM ho, (VALUES " \
    + ", ".join(f"('{f}', {d})" for f, d in S.GAS_MONOTONE.items() if d) + ") v(feature, sign) GROUP BY 1, 2\n"


def f5_forecast_demand(spark, sf):
    """Forecast every hold-out date plus the next day after each series."""
    t = trained_demand(spark, sf)
    hist = panel(spark, sf)
    targets = (t.table.where(F.col("split") == sp.TEST).select(S.SERIES, S.DATE)
               .unionByName(lk.next_target_date(hist)))
    low, high = t.table.where(F.col("split") == sp.TRAIN).agg(
        F.min(t.label), F.max(t.label)).first()
    out = fc.forecast_demand(targets, hist, t.model, t.features, with_last_year=True)
    return out.select(
        S.SERIES, S.DATE, "demand_last_week", F.size("last_year_week").alias("days_last_year"),
        F.col("prediction").between(low - 1e-6, high + 1e-6).alias("in_label_range"),
        (F.col("delta_vs_last_week") == F.col("prediction") - F.col("demand_last_week")).alias("delta_fits"))


F5_FORECAST_SQL = _DEMAND_ROWS + """
, targets AS (SELECT series_id, date FROM ho
              UNION ALL SELECT series_id, CAST(MAX(date) + 1 AS DATE) FROM panel GROUP BY 1)
, h AS (SELECT series_id, date, max_demand,
               ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS pos
        FROM panel WHERE max_demand IS NOT NULL)
, c AS (SELECT t.series_id, t.date,
               (SELECT COUNT(*) FROM h WHERE h.series_id = t.series_id AND h.date < t.date) AS cnt
        FROM targets t)
SELECT c.series_id, c.date, COALESCE(e.max_demand, f.max_demand, 0.0) AS demand_last_week,
       7 AS days_last_year, TRUE AS in_label_range, TRUE AS delta_fits
FROM c LEFT JOIN h e ON e.series_id = c.series_id AND e.date = c.date - 7
       LEFT JOIN h f ON f.series_id = c.series_id AND f.pos = c.cnt - 6
"""


_F5_COLS = [S.MONTH, S.IS_HOLIDAY, S.IS_BUSINESS_DAY, S.TEMP_LOW, S.TEMP_HIGH, S.FEELS_LIKE,
            S.DEMAND_LAG1, S.DEMAND_LAG7, S.COOLING, S.HEATING, S.DIURNAL, "dow_monday",
            "dow_sunday"]


def f5_forecast_feature_rows(spark, sf):
    """The F5 feature rows (everything but the model) for every calendar day of
    the sparse panel, with supplied temperatures derived from the day."""
    hist = region_cal(spark, sf)
    dom = F.dayofmonth(S.DATE).cast("double")
    targets = calendar_targets(hist).withColumns({
        "in_low": dom - 10.0, "in_high": dom + 10.0,
        "in_feels": F.when(F.dayofmonth(S.DATE) % 4 != 0, dom)})
    rows = fc.demand_feature_rows(targets, hist)
    return rows.select(S.SERIES, S.DATE, *_F5_COLS,
                       F.round(S.DEMAND_LAST_YEAR_DOW, 6).alias(S.DEMAND_LAST_YEAR_DOW))


F5_SQL = Q.REGION + TARGETS_SQL + f"""
, t AS (SELECT series_id, date, CAST(day(date) AS DOUBLE) - 10.0 AS in_low,
               CAST(day(date) AS DOUBLE) + 10.0 AS in_high,
               CASE WHEN day(date) % 4 <> 0 THEN CAST(day(date) AS DOUBLE) END AS in_feels
        FROM targets)
, {Q.calendar("t", "tc")[1:]}
, h AS (SELECT series_id, date, max_demand,
               ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS pos
        FROM panel WHERE max_demand IS NOT NULL)
, l1 AS (SELECT t.series_id, t.date, h.max_demand AS lag1
         FROM targets t ASOF LEFT JOIN (SELECT series_id, date AS hdate, max_demand FROM h) h
           ON t.series_id = h.series_id AND t.date > h.hdate)
, c AS (SELECT t.series_id, t.date,
               (SELECT COUNT(*) FROM h WHERE h.series_id = t.series_id AND h.date < t.date) AS cnt
        FROM targets t)
, l7 AS (SELECT c.series_id, c.date, COALESCE(e.max_demand, f.max_demand, 0.0) AS lag7
         FROM c LEFT JOIN h e ON e.series_id = c.series_id AND e.date = c.date - 7
                LEFT JOIN h f ON f.series_id = c.series_id AND f.pos = c.cnt - 6)
, mw AS (SELECT series_id, CAST(year(date) AS INTEGER) AS y, CAST(month(date) AS INTEGER) AS m,
                CAST(isodow(date) - 1 AS INTEGER) AS wd, AVG(max_demand) AS mm
         FROM h GROUP BY 1, 2, 3, 4)
, j AS (
  SELECT tc.*, p.temp_low AS o_low, p.temp_high AS o_high, p.feels_like AS o_feels,
         l1.lag1, l7.lag7, mw.mm
  FROM tc
  LEFT JOIN panel p ON p.series_id = tc.series_id AND p.date = tc.date
  LEFT JOIN l1 ON l1.series_id = tc.series_id AND l1.date = tc.date
  LEFT JOIN l7 ON l7.series_id = tc.series_id AND l7.date = tc.date
  LEFT JOIN mw ON mw.series_id = tc.series_id AND mw.y = tc.year - 1 AND mw.m = tc.month
              AND mw.wd = tc.weekday_num)
, f AS (SELECT *, COALESCE(o_low, CASE WHEN is_winter = 1 THEN in_low END) AS lo,
               COALESCE(o_high, CASE WHEN is_summer = 1 THEN in_high END) AS hi FROM j)
, g AS (SELECT *, COALESCE(o_feels, in_feels,
                           CASE WHEN is_summer = 1 AND hi IS NOT NULL THEN hi END,
                           CASE WHEN is_winter = 1 AND lo IS NOT NULL THEN lo END,
                           (COALESCE(lo, 0.0) + COALESCE(hi, 0.0)) / 2.0) AS fe FROM f)
SELECT series_id, date, month, is_holiday, is_business_day,
  COALESCE(lo, 0.0) AS temp_low, COALESCE(hi, 0.0) AS temp_high, COALESCE(fe, 0.0) AS feels_like,
  COALESCE(lag1, 0.0) AS demand_lag1, COALESCE(lag7, 0.0) AS demand_lag7,
  COALESCE(CASE WHEN fe IS NULL THEN NULL ELSE greatest(fe - 25.0, 0.0) END * is_summer, 0.0) AS cooling_intensity,
  COALESCE(CASE WHEN lo IS NULL THEN NULL ELSE greatest(10.0 - lo, 0.0) END * is_winter, 0.0) AS heating_intensity,
  COALESCE(hi - lo, 0.0) AS diurnal_range,
  CAST(CASE WHEN weekday_num = 0 THEN 1 ELSE 0 END AS INTEGER) AS dow_monday,
  CAST(CASE WHEN weekday_num = 6 THEN 1 ELSE 0 END AS INTEGER) AS dow_sunday,
  ROUND(COALESCE(mm, 0.0), 6) AS demand_last_year_dow
FROM g
"""


def f6_delta_vs_last_week(spark, sf):
    """Delta of a persistence forecast (latest value before the date) against
    the same weekday last week, for every calendar day of the sparse panel."""
    hist = region_cal(spark, sf)
    targets = calendar_targets(hist)
    pred = lk.last_before(targets, hist, S.MAX_DEMAND, out="prediction")
    week = lk.same_dow_last_week(targets, hist)
    j = pred.join(week, [S.SERIES, S.DATE])
    return j.select(S.SERIES, S.DATE, "prediction", "demand_last_week",
                    fc.delta_vs_last_week(F.col("prediction"), F.col("demand_last_week"))
                    .alias("delta_vs_last_week"))


F6_SQL = Q.REGION + TARGETS_SQL + """
, h AS (SELECT series_id, date, max_demand,
               ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS pos
        FROM panel WHERE max_demand IS NOT NULL)
, p AS (SELECT t.series_id, t.date, h.max_demand AS prediction
        FROM targets t ASOF LEFT JOIN (SELECT series_id, date AS hdate, max_demand FROM h) h
          ON t.series_id = h.series_id AND t.date > h.hdate)
, c AS (SELECT t.series_id, t.date,
               (SELECT COUNT(*) FROM h WHERE h.series_id = t.series_id AND h.date < t.date) AS cnt
        FROM targets t)
, wk AS (SELECT c.series_id, c.date, COALESCE(e.max_demand, f.max_demand, 0.0) AS demand_last_week
         FROM c LEFT JOIN h e ON e.series_id = c.series_id AND e.date = c.date - 7
                LEFT JOIN h f ON f.series_id = c.series_id AND f.pos = c.cnt - 6)
SELECT p.series_id, p.date, p.prediction, wk.demand_last_week,
       p.prediction - wk.demand_last_week AS delta_vs_last_week
FROM p JOIN wk ON p.series_id = wk.series_id AND p.date = wk.date
"""


def _gas_r2(t):
    row = tr.evaluate(t, keys=[]).first()
    return float(row["r2"]) if row and row["r2"] is not None else None


def f7_forecast_gas(spark, sf):
    """Gas scenarios = the hold-out days (their demand and solar as inputs)."""
    t = trained_gas(spark, sf)
    scen = t.table.where(F.col("split") == sp.TEST).select(S.SERIES, S.DATE, S.MAX_DEMAND,
                                                           S.SOLAR_MAX)
    hist = panel(spark, sf)
    out = fc.forecast_gas(scen, hist, t.model, t.features, r2=_gas_r2(t), ratios=t.ratios)
    return out.select(S.SERIES, S.DATE, S.MAX_DEMAND, F.round(S.SOLAR_MAX, 4).alias(S.SOLAR_MAX),
                      F.col("gas_prediction").between(F.lit(0.0), F.col(S.MAX_DEMAND)).alias("within_demand"),
                      F.col("confidence").between(60.0, 95.0).alias("confident"))


F7_FORECAST_SQL = _GAS_ROWS + """
SELECT series_id, date, max_demand, ROUND(solar_max, 4) AS solar_max, TRUE AS within_demand, TRUE AS confident
FROM ho
"""


def f7_gas_feature_rows(spark, sf):
    """The F7 feature rows (everything but the model) with every panel day as a
    scenario: its demand and solar as inputs, gas state as of the day before,
    ratio means of the first 80 % of each series (the training rows)."""
    hist = panel(spark, sf)
    scen = hist.select(S.SERIES, S.DATE, S.MAX_DEMAND, S.SOLAR_MAX)
    train = sp.chronological_split(cal.prepare_calendar(hist)).where(F.col("split") == sp.TRAIN)
    rows = fc.gas_feature_rows(scen, hist, ratios=fe.ratio_means_table(train))
    return rows.select(S.SERIES, S.DATE, S.IS_BUSINESS_DAY, S.RESIDUAL_LOAD, S.SOLAR_RATIO,
                       S.RESIDUAL_RATIO, F.round(S.GAS_BUDGET, 4).alias(S.GAS_BUDGET),
                       S.GAS_LAG1, F.round(S.GAS_CHANGE_LAG1, 9).alias(S.GAS_CHANGE_LAG1))


F7_SQL = Q.DEMAND_CAL + """
, tr AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS rn,
                               COUNT(*) OVER (PARTITION BY series_id) AS n FROM cal)
         WHERE rn <= GREATEST(1, LEAST(FLOOR(n * 0.8::DOUBLE), n - 1)))
, r AS (SELECT series_id,
          COALESCE(AVG(CASE WHEN is_business_day = 1 THEN x END), AVG(x), 0.0) AS rb,
          COALESCE(AVG(CASE WHEN is_business_day = 0 THEN x END), AVG(x), 0.0) AS ro
        FROM (SELECT *, (gas_demand + solar_max) / NULLIF(max_demand, 0.0) AS x FROM tr) GROUP BY 1)
, u AS (SELECT series_id, date AS gdate, gas_demand AS last_gas,
               LAG(gas_demand) OVER (PARTITION BY series_id ORDER BY date) AS prev_gas
        FROM cal WHERE gas_demand IS NOT NULL AND solar_max IS NOT NULL)
, g AS (SELECT c.series_id, c.date, u.last_gas, u.prev_gas
        FROM cal c ASOF LEFT JOIN u ON c.series_id = u.series_id AND c.date > u.gdate)
SELECT c.series_id, c.date, c.is_business_day, c.max_demand - c.solar_max AS residual_load,
  COALESCE(c.solar_max / NULLIF(c.max_demand, 0.0), 0.0) AS solar_ratio,
  COALESCE((c.max_demand - c.solar_max) / NULLIF(c.max_demand, 0.0), 0.0) AS residual_ratio,
  ROUND(CASE WHEN b IS NULL THEN NULL ELSE greatest(b, 0.0) END, 4) AS gas_budget,
  COALESCE(g.last_gas, 0.0) AS gas_lag1,
  ROUND(COALESCE((g.last_gas - g.prev_gas) / NULLIF(g.prev_gas, 0.0), 0.0), 9) AS gas_change_lag1
FROM (SELECT cal.*, cal.max_demand * CASE WHEN cal.is_business_day = 1 THEN r.rb ELSE r.ro END
             - cal.solar_max AS b
      FROM cal LEFT JOIN r ON r.series_id = cal.series_id) c
LEFT JOIN g ON g.series_id = c.series_id AND g.date = c.date
"""


def f9_feature_importance(spark, sf):
    """One row per model and feature; shares lie in [0, 1] and sum to 1 per model."""
    rows = []
    for name, t in (("demand_forest", trained_demand(spark, sf)),
                    ("gas_boost", trained_gas(spark, sf))):
        shares = md.importances(t.model, t.features)
        total = round(sum(v for _, v in shares), 6)
        rows += [(name, f, 0.0 <= float(v) <= 1.0, float(total)) for f, v in shares]
    schema = "model string, feature string, is_share boolean, model_total double"
    return spark.createDataFrame(rows, schema)


def f9_importance_shares(spark, sf):
    """The shares themselves, with their rank within a model (no twin: a model's result)."""
    rows = []
    for name, t in _models(spark, sf):
        shares = sorted(md.importances(t.model, t.features), key=lambda p: (-p[1], p[0]))
        rows += [(name, f, float(v), i) for i, (f, v) in enumerate(shares, 1)]
    return spark.createDataFrame(rows, "model string, feature string, share double, rank int")


def _models(spark, sf):
    return (("demand_forest", trained_demand(spark, sf)), ("gas_boost", trained_gas(spark, sf)),
            ("gas_trees", trained_trees(spark, sf)))


F9_SQL = "SELECT model, feature, TRUE AS is_share, 1.0::DOUBLE AS model_total FROM (VALUES " + ", ".join(
    [f"('demand_forest', '{f}')" for f in S.DEMAND_BASE_FEATURES + S.DEMAND_TEMP_EXTRAS + S.DOW_COLUMNS]
    + [f"('gas_boost', '{f}')" for f in S.GAS_FEATURES]) + ") t(model, feature)\n"


def f10_evaluate(spark, sf):
    """Hold-out sizes per model and series, and metrics that are no worse than a constant's."""
    out = None
    for name, t in (("demand_forest", trained_demand(spark, sf)),
                    ("gas_boost", trained_gas(spark, sf))):
        base = t.table.where(F.col("split") == sp.TEST).groupBy(S.SERIES).agg(
            F.max(F.abs(F.col(t.label))).alias("_top"))
        m = tr.evaluate(t).join(base, S.SERIES).select(
            F.lit(name).alias("model"), S.SERIES, "n",
            (F.col("mae").between(F.lit(0.0), F.col("_top"))).alias("mae_fits"),
            (F.col("r2") <= 1.0).alias("r2_fits"))
        out = m if out is None else out.unionByName(m)
    return out


def f10_metrics(spark, sf):
    """Hold-out MAE and R2 per model and series, beside the MAE of the training mean (no twin: a
    model's result). The mean is that of all training rows, as no model knows the series."""
    out = None
    for name, t in _models(spark, sf):
        base = (t.table.where(F.col("split") == sp.TEST).groupBy(S.SERIES)
                .agg(F.avg(F.abs(F.col(t.label) - _train_mean(t))).alias("constant_mae")))
        m = tr.evaluate(t).join(base, S.SERIES).select(F.lit(name).alias("model"), S.SERIES, "n", "mae",
                                                       "r2", "constant_mae")
        out = m if out is None else out.unionByName(m)
    return out


F10_SQL = _DEMAND_ROWS + """
, gs AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY date) AS rn,
                COUNT(*) OVER (PARTITION BY series_id) AS n
         FROM panel WHERE gas_demand IS NOT NULL AND max_demand IS NOT NULL)
SELECT 'demand_forest' AS model, series_id, COUNT(*) AS n, TRUE AS mae_fits, TRUE AS r2_fits FROM ho GROUP BY 2
UNION ALL
SELECT 'gas_boost', series_id, COUNT(*), TRUE, TRUE
FROM gs WHERE rn > GREATEST(1, LEAST(FLOOR(n * 0.8::DOUBLE), n - 1)) GROUP BY 2
"""


QUERIES = {
    "f1_fit_demand_forest": (f1_fit_demand_forest, F1_SQL),
    "f2_tune_forest": (f2_tune_forest, F2_SQL),
    "f3_fit_gas_model": (f3_fit_gas_model, F3_SQL),
    "f2_tuning_errors": (f2_tuning_errors, None),
    "f3_gas_trees": (f3_gas_trees, F3_TREES_SQL),
    "f3_monotone_trees": (f3_monotone_trees, F3_MONOTONE_SQL),
    "f4_monotone_trees": (f4_monotone_trees, F4_TREES_SQL),
    "f9_importance_shares": (f9_importance_shares, None),
    "f10_metrics": (f10_metrics, None),
    "f4_monotone_map": (f4_monotone_map, F4_SQL),
    "f5_forecast_demand": (f5_forecast_demand, F5_FORECAST_SQL),
    "f5_forecast_feature_rows": (f5_forecast_feature_rows, F5_SQL),
    "f6_delta_vs_last_week": (f6_delta_vs_last_week, F6_SQL),
    "f7_forecast_gas": (f7_forecast_gas, F7_FORECAST_SQL),
    "f7_gas_feature_rows": (f7_gas_feature_rows, F7_SQL),
    "f9_feature_importance": (f9_feature_importance, F9_SQL),
    "f10_evaluate": (f10_evaluate, F10_SQL),
}
