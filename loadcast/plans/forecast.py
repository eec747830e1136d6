"""Batch forecasts: peak demand for target dates (F5, F6) and gas for
scenarios (F7, F8, B27, B28).

Targets and scenarios are DataFrames, so a forecast for millions of
(series, date) pairs is one distributed job: lookups against history are
joins and windows keyed by series, the feature row is built with the same
expressions as training (one shared feature function for both), and the model
scores it in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.functions import calendar as cal
from loadcast.functions import scalars as sc
from loadcast.operators import features as fe
from loadcast.operators import lookup as lk
from loadcast.plans import models as md


def demand_feature_rows(targets: DataFrame, history: DataFrame,
                        extra_holidays: DataFrame | None = None, lag_by: str = "rows",
                        last_year_mode: str = "per_row",
                        day_type_override: bool = True,
                        month_weekday: DataFrame | None = None) -> DataFrame:
    """F5 feature rows for ``targets`` (series_id, date [, in_low, in_high, in_feels]).

    * temperatures: observed on the date (E3), else supplied (B25);
    * holiday / business day: calendar, with a supplied day type in history
      for that date deciding unless it is a holiday (B26);
    * lags: latest value before the date (E4), same weekday last week (E5),
      prior-year (month, weekday) mean from the D1 table (E1); ``lag_by`` and
      ``last_year_mode`` as in training (``rows``: the value dated 7 days before,
      else the 7th latest, which on a series without gaps is the row lag;
      ``calendar``: the value dated 7 days before only);
    * cooling / heating / diurnal range and weekday one-hots as in training.

    ``month_weekday`` is a kept D1 table; with it (mode ``per_row``) the prior
    year's means come from there and ``history`` needs its latest rows only.
    """
    keys = [S.SERIES]
    t = targets
    for c in ("in_low", "in_high", "in_feels"):
        if c not in t.columns:
            t = t.withColumn(c, F.lit(None).cast("double"))
    t = t.select(*keys, S.DATE, "in_low", "in_high", "in_feels")
    t = cal.prepare_calendar(t.drop(S.DAY_TYPE) if S.DAY_TYPE in t.columns else t,
                             extra_holidays)
    t = cal.season_flags(cal.calendar_parts(t))
    obs_cols = [c for c in (S.TEMP_LOW, S.TEMP_HIGH, S.FEELS_LIKE, S.DAY_TYPE)
                if c in history.columns]
    t = lk.observed_on(t, history, obs_cols)
    temps = sc.fallback_temperatures(
        F.col("obs_temp_low") if S.TEMP_LOW in obs_cols else F.lit(None).cast("double"),
        F.col("obs_temp_high") if S.TEMP_HIGH in obs_cols else F.lit(None).cast("double"),
        F.col("obs_feels_like") if S.FEELS_LIKE in obs_cols else F.lit(None).cast("double"),
        F.col("in_low"), F.col("in_high"), F.col("in_feels"),
        F.col(S.IS_SUMMER), F.col(S.IS_WINTER))
    t = t.withColumns(temps)
    if day_type_override and S.DAY_TYPE in obs_cols:
        t = t.withColumn(S.IS_BUSINESS_DAY, cal.business_day_override(
            F.col(S.IS_HOLIDAY), F.col(S.IS_BUSINESS_DAY), F.col("obs_day_type")))
    t = t.drop(*[c for c in t.columns if c.startswith("obs_")])
    hist = history.where(F.col(S.MAX_DEMAND).isNotNull())
    tk = t.select(*keys, S.DATE).distinct()
    lag1 = lk.last_before(tk, hist, S.MAX_DEMAND, out="_lag1")
    lag7 = lk.same_dow_last_week(tk, hist) if lag_by == "rows" else _week_before(tk, hist)
    t = (t.join(lag1.select(*keys, S.DATE, "_lag1"), keys + [S.DATE], "left")
         .join(lag7, keys + [S.DATE], "left"))
    t = _last_year_mean(t, cal.calendar_parts(cal.with_weekday(hist)), last_year_mode, month_weekday)
    t = t.withColumns({
        S.DEMAND_LAG1: F.coalesce("_lag1", F.lit(0.0)),
        S.DEMAND_LAG7: F.coalesce("demand_last_week", F.lit(0.0)),
        S.DEMAND_LAST_YEAR_DOW: F.coalesce("_ly", F.lit(0.0)),
    }).drop("_lag1", "_ly")
    t = sc.cooling_intensity(t)
    t = sc.heating_intensity(t)
    t = sc.diurnal_range(t).withColumn(S.DIURNAL, F.coalesce(F.col(S.DIURNAL), F.lit(0.0)))
    t = t.withColumns({c: F.coalesce(F.col(c), F.lit(0.0))
                       for c in (S.COOLING, S.HEATING, S.TEMP_HIGH, S.TEMP_LOW, S.FEELS_LIKE)})
    return cal.weekday_one_hot(t, drop_source=True)


def _week_before(targets: DataFrame, hist: DataFrame) -> DataFrame:
    """The value dated exactly 7 days before each target, as training's calendar lag."""
    value = hist.groupBy(S.SERIES, F.date_add(S.DATE, 7).alias(S.DATE)).agg(
        F.max(S.MAX_DEMAND).cast("double").alias("demand_last_week"))
    return targets.join(value, [S.SERIES, S.DATE], "left")


def _last_year_mean(t: DataFrame, hcal: DataFrame, mode: str,
                    month_weekday: DataFrame | None = None) -> DataFrame:
    """``_ly`` for targets with year, month and weekday, by the mode training used."""
    if mode == "disabled":
        return t.withColumn("_ly", F.lit(0.0))
    if mode == "per_row":
        known = fe.month_weekday_table(hcal) if month_weekday is None else month_weekday
        mw = known.select(
            S.SERIES, (F.col(S.YEAR) + 1).alias(S.YEAR), S.MONTH, S.WEEKDAY_NUM,
            F.col("mean_max_demand").alias("_ly"))
        return t.join(mw, [S.SERIES, S.YEAR, S.MONTH, S.WEEKDAY_NUM], "left")
    if mode != "fixed":
        raise ValueError(f"unknown mode {mode!r}")
    fixed = (fe.last_year_dow_mean(hcal, mode="fixed")
             .groupBy(S.SERIES, S.MONTH, S.WEEKDAY_NUM)
             .agg(F.first(S.DEMAND_LAST_YEAR_DOW).alias("_ly")))
    return t.join(fixed, [S.SERIES, S.MONTH, S.WEEKDAY_NUM], "left")


def last_year_week(targets: DataFrame, history: DataFrame) -> DataFrame:
    """E6 beside each forecast: the week around the date last year, as one array per target."""
    week = lk.same_week_last_year(targets.select(S.SERIES, S.DATE).distinct(), history)
    days = F.sort_array(F.collect_list(F.struct(S.DATE, S.WEEKDAY_NAME, S.MAX_DEMAND)))  # 7 rows
    return week.groupBy(S.SERIES, F.col("target_date").alias(S.DATE)).agg(
        days.alias("last_year_week"))


def forecast_demand(targets: DataFrame, history: DataFrame, model, features: list[str],
                    extra_holidays: DataFrame | None = None, with_last_year: bool = False,
                    **options) -> DataFrame:
    """F5 + F6: prediction per target, the same-weekday-last-week value and the delta.

    ``with_last_year`` adds the week around the date last year (E6). Pass the
    ``lag_by``, ``last_year_mode`` and ``day_type_override`` of training.
    """
    rows = demand_feature_rows(targets, history, extra_holidays, **options)
    aligned = sc.align_features(rows, features, keep=[S.SERIES, S.DATE, "demand_last_week"])
    pred = md.predict(model, aligned, features)
    out = pred.select(S.SERIES, S.DATE, "prediction",
                       F.coalesce("demand_last_week", F.lit(0.0)).alias("demand_last_week"),
                       delta_vs_last_week(F.col("prediction"),
                                          F.coalesce("demand_last_week", F.lit(0.0)))
                       .alias("delta_vs_last_week"))
    return out.join(last_year_week(targets, history), [S.SERIES, S.DATE], "left") \
        if with_last_year else out


def delta_vs_last_week(prediction, last_week):
    """prediction minus the same weekday last week."""
    return prediction - last_week


def gas_feature_rows(scenarios: DataFrame, history: DataFrame,
                     extra_holidays: DataFrame | None = None, ratios: DataFrame | None = None,
                     day_type_override: bool = True) -> DataFrame:
    """F7 feature rows for scenarios ``(series_id, date, max_demand, solar_max)``.

    Nothing dated on or after a scenario's date is used: the last two gas
    values are those before it, and the ratio means (D2) are the trained state
    ``ratios``. Without that state they are the means over the history before
    each series' first scenario. A scenario's own ``weekday_name`` and
    ``day_type`` decide its business day; else they come from the date.
    """
    keys = [S.SERIES]
    own = [c for c in (S.WEEKDAY_NAME, S.DAY_TYPE) if c in scenarios.columns]
    s = scenarios.select(*keys, S.DATE, F.col(S.MAX_DEMAND).cast("double"),
                         F.col(S.SOLAR_MAX).cast("double"), *own)
    if S.DAY_TYPE in own:
        s = s.withColumn("_given", F.col(S.DAY_TYPE))
    s = cal.prepare_calendar(s, extra_holidays)
    if S.WEEKDAY_NAME in own:
        given = F.array_position(F.array(*[F.lit(n) for n in S.WEEKDAY_NAMES]),
                                 F.initcap(F.trim(F.col(S.WEEKDAY_NAME))))
        s = s.withColumn(S.WEEKDAY_NUM, F.when(given > 0, given.cast("int") - 1)
                         .otherwise(F.col(S.WEEKDAY_NUM)))
        s = s.withColumn(S.IS_BUSINESS_DAY, ((F.col(S.WEEKDAY_NUM) < 5)
                                             & (F.col(S.IS_HOLIDAY) == 0)).cast("int"))
    if day_type_override and S.DAY_TYPE in own:
        s = s.withColumn(S.IS_BUSINESS_DAY, cal.business_day_override(
            F.col(S.IS_HOLIDAY), F.col(S.IS_BUSINESS_DAY), F.col("_given")))
    s = sc.residual_and_ratios(s)
    if ratios is None:
        first = scenarios.groupBy(*keys).agg(F.min(S.DATE).alias("_first"))
        past = history.join(first, keys).where(F.col(S.DATE) < F.col("_first")).drop("_first")
        ratios = fe.ratio_means_table(cal.prepare_calendar(past, extra_holidays, day_type_override))
    state = lk.gas_before(s, history)
    s = s.join(ratios, keys, "left").join(state, keys + [S.DATE], "left")
    pick = F.when(F.col(S.IS_BUSINESS_DAY) == 1, F.col("ratio_business")) \
        .otherwise(F.col("ratio_other"))
    return s.withColumns({
        S.GAS_BUDGET: sc.gas_budget_expr(F.col(S.MAX_DEMAND), F.coalesce(pick, F.lit(0.0)),
                                         F.col(S.SOLAR_MAX)),
        S.GAS_LAG1: F.coalesce("last_gas", F.lit(0.0)),
        S.GAS_CHANGE_LAG1: sc.gas_rate(F.col("last_gas"), F.col("prev_gas")),
    })


def forecast_gas(scenarios: DataFrame, history: DataFrame, model, features: list[str],
                 r2: float | None = None, extra_holidays: DataFrame | None = None,
                 ratios: DataFrame | None = None, day_type_override: bool = True) -> DataFrame:
    """predicted gas per scenario, clipped to [0, demand] (B27), with the
    confidence score of the model (B28)."""
    rows = gas_feature_rows(scenarios, history, extra_holidays, ratios, day_type_override)
    pred = md.predict(model, rows, features)
    conf = sc.confidence_score(F.lit(r2).cast("double"))
    return pred.select(S.SERIES, S.DATE, S.MAX_DEMAND, S.SOLAR_MAX,
                       sc.clip_prediction(F.col("prediction"), F.col(S.MAX_DEMAND))
                       .alias("gas_prediction"),
                       conf.alias("confidence"))
