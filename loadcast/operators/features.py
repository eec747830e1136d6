"""Per-series window features: lags, gas change, prior-year means, ratio means.

All windows share ``partitionBy(series_id)`` so Spark plans one hash exchange
for the whole feature table; frames order by an integer day number
(``unix_date``) so calendar offsets are RANGE frames on the same sort instead
of self joins. Inputs are daily panels (one row per series and date), so a
window partition holds at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.functions import calendar as cal
from loadcast.functions import scalars as sc

DNUM = "_dnum"


def day_number(date_col: str = S.DATE) -> Column:
    return F.unix_date(F.col(date_col))


def series_window(keys: list[str] | None = None):
    """W = partitionBy(series).orderBy(date); ``date`` breaks no ties (daily panel)."""
    keys = keys or [S.SERIES]
    return Window.partitionBy(*keys).orderBy(S.DATE)


def _calendar_window(keys: list[str], lo: int, hi: int):
    return Window.partitionBy(*keys).orderBy(day_number()).rangeBetween(lo, hi)


def lag_by_rows(value: str, n: int, keys: list[str] | None = None) -> Column:
    """Value ``n`` rows earlier within the series (row order = date)."""
    return F.lag(F.col(value), n).over(series_window(keys))


def lag_by_calendar(value: str, days: int, keys: list[str] | None = None) -> Column:
    """C2 option: value exactly ``days`` calendar days earlier (null when absent)."""
    keys = keys or [S.SERIES]
    return F.max(F.col(value)).over(_calendar_window(keys, -days, -days))


def demand_lags(df: DataFrame, by: str = "rows", keys: list[str] | None = None) -> DataFrame:
    """C1 + C2: ``demand_lag1`` (previous row) and ``demand_lag7``.

    ``by="rows"`` keeps the reference's positional meaning (7 rows earlier);
    ``by="calendar"`` uses the value dated exactly 7 days earlier.
    """
    lag7 = lag_by_rows(S.MAX_DEMAND, 7, keys) if by == "rows" else \
        lag_by_calendar(S.MAX_DEMAND, 7, keys)
    return df.withColumns({
        S.DEMAND_LAG1: lag_by_rows(S.MAX_DEMAND, 1, keys),
        S.DEMAND_LAG7: lag7,
    })


def gas_lags(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """C3 + C4: previous gas value and its lagged change rate.

    The change rate follows ``pct_change().shift(1)``: gas is forward filled,
    then (g[t-1] - g[t-2]) / g[t-2]; a zero base gives null. Both columns are
    null for a series with no row where gas and solar are both present.
    """
    keys = keys or [S.SERIES]
    w = series_window(keys)
    filled = F.last(F.col(S.GAS_DEMAND), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    usable = F.max((F.col(S.GAS_DEMAND).isNotNull() & F.col(S.SOLAR_MAX).isNotNull())
                   .cast("int")).over(Window.partitionBy(*keys))
    out = df.withColumns({"_gfill": filled, "_gusable": usable})
    g1 = F.lag("_gfill", 1).over(w)
    g2 = F.lag("_gfill", 2).over(w)
    ok = F.col("_gusable") == 1
    return (out.withColumns({
        S.GAS_LAG1: F.when(ok, F.lag(F.col(S.GAS_DEMAND), 1).over(w)),
        S.GAS_CHANGE_LAG1: F.when(ok, F.try_divide(g1 - g2, F.nullif(g2, F.lit(0.0)))),
    }).drop("_gfill", "_gusable"))


def month_weekday_key() -> Column:
    """Sort key (month, weekday, year) packed into one integer for RANGE frames."""
    return (F.col(S.MONTH) * 10 + F.col(S.WEEKDAY_NUM)) * 10000 + F.col(S.YEAR)


def last_year_dow_mean(df: DataFrame, mode: str = "per_row",
                       keys: list[str] | None = None) -> DataFrame:
    """D1 + E1: ``demand_last_year_dow``, the prior-year mean for (month, weekday).

    * ``per_row`` - mean over the rows of year - 1 with the row's month and
      weekday (a RANGE frame of exactly one key step, so no join and no
      look-ahead); missing -> 0.
    * ``fixed`` - the reference rule: one year (latest year - 1) for every
      row, or all rows when that year has none; missing -> 0.
    * ``disabled`` - always 0 (what the reference ends up computing).
    Needs ``year``, ``month``, ``weekday_num``.
    """
    keys = keys or [S.SERIES]
    if mode == "disabled":
        return df.withColumn(S.DEMAND_LAST_YEAR_DOW, F.lit(0.0))
    if mode == "per_row":
        w = Window.partitionBy(*keys).orderBy(month_weekday_key()).rangeBetween(-1, -1)
        return df.withColumn(S.DEMAND_LAST_YEAR_DOW,
                             F.coalesce(F.avg(S.MAX_DEMAND).over(w), F.lit(0.0)))
    if mode != "fixed":
        raise ValueError(f"unknown mode {mode!r}")
    whole = Window.partitionBy(*keys)
    cell = Window.partitionBy(*keys, S.MONTH, S.WEEKDAY_NUM)
    target = F.max(S.YEAR).over(whole) - 1
    out = df.withColumn("_ty", target)
    in_target = F.col(S.YEAR) == F.col("_ty")
    has_target = F.max(in_target.cast("int")).over(whole) == 1
    out = out.withColumn("_has", has_target)
    mean_target = F.avg(F.when(in_target, F.col(S.MAX_DEMAND))).over(cell)
    mean_all = F.avg(S.MAX_DEMAND).over(cell)
    value = F.when(F.col("_has"), mean_target).otherwise(mean_all)
    return (out.withColumn(S.DEMAND_LAST_YEAR_DOW, F.coalesce(value, F.lit(0.0)))
            .drop("_ty", "_has"))


def month_weekday_table(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """D1 as a table: mean max_demand per (series, year, month, weekday).

    Used at forecast time: a target looks up (year - 1, month, weekday).
    Partial aggregation keeps the shuffle at one row per task and cell.
    """
    keys = keys or [S.SERIES]
    return (df.groupBy(*keys, S.YEAR, S.MONTH, S.WEEKDAY_NUM)
            .agg(F.avg(S.MAX_DEMAND).alias("mean_max_demand"),
                 F.count(S.MAX_DEMAND).alias("n_days")))


def total_ratio(df: DataFrame) -> Column:
    """(gas + solar) / demand, null for zero or missing demand."""
    return F.try_divide(F.col(S.GAS_DEMAND) + F.col(S.SOLAR_MAX),
                        F.nullif(F.col(S.MAX_DEMAND), F.lit(0.0)))


def ratio_mean_columns(fit_mask: Column | None = None,
                       keys: list[str] | None = None) -> dict[str, Column]:
    """D2 as window columns: business-day / other-day means of the total ratio.

    A side with no rows falls back to the overall mean, then to 0. Rows
    outside ``fit_mask`` (e.g. the hold-out) do not contribute.
    """
    keys = keys or [S.SERIES]
    whole = Window.partitionBy(*keys)
    r = F.try_divide(F.col(S.GAS_DEMAND) + F.col(S.SOLAR_MAX),
                     F.nullif(F.col(S.MAX_DEMAND), F.lit(0.0)))
    if fit_mask is not None:
        r = F.when(fit_mask, r)
    bd = F.col(S.IS_BUSINESS_DAY)
    overall = F.avg(r).over(whole)
    return {
        "ratio_business": F.coalesce(F.avg(F.when(bd == 1, r)).over(whole), overall,
                                     F.lit(0.0)),
        "ratio_other": F.coalesce(F.avg(F.when(bd == 0, r)).over(whole), overall,
                                  F.lit(0.0)),
    }


def ratio_means_table(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """D2 as model state: one row per series (for forecast-time joins)."""
    keys = keys or [S.SERIES]
    r = total_ratio(df)
    bd = F.col(S.IS_BUSINESS_DAY)
    agg = df.groupBy(*keys).agg(
        F.avg(F.when(bd == 1, r)).alias("_wd"),
        F.avg(F.when(bd == 0, r)).alias("_we"),
        F.avg(r).alias("ratio_overall"))
    return agg.select(
        *keys,
        F.coalesce("_wd", "ratio_overall", F.lit(0.0)).alias("ratio_business"),
        F.coalesce("_we", "ratio_overall", F.lit(0.0)).alias("ratio_other"),
        F.coalesce("ratio_overall", F.lit(0.0)).alias("ratio_overall"))


def gas_features(df: DataFrame, fit_mask: Column | None = None,
                 keys: list[str] | None = None) -> DataFrame:
    """Residual load, ratios, budget, gas lags."""
    out = gas_lags(sc.residual_and_ratios(df), keys)
    out = out.withColumns(ratio_mean_columns(fit_mask, keys))
    ratio = F.when(F.col(S.IS_BUSINESS_DAY) == 1, F.col("ratio_business")) \
        .otherwise(F.col("ratio_other"))
    return out.withColumn(S.GAS_BUDGET, sc.gas_budget_expr(
        F.col(S.MAX_DEMAND), ratio, F.col(S.SOLAR_MAX))).drop("ratio_business",
                                                              "ratio_other")


def build_features(panel: DataFrame, *, lag_by: str = "rows",
                   last_year_mode: str = "per_row",
                   extra_holidays: DataFrame | None = None,
                   day_type_override: bool = True,
                   keys: list[str] | None = None) -> DataFrame:
    """Step 1 + 2: the full feature table of a daily panel.

    One lazy plan: calendar expressions, then every window over the shared
    series partitioning, then the essential-null filter (after the lags, as in
    the reference, so a missing day still shifts the lags).
    """
    keys = keys or [S.SERIES]
    out = cal.prepare_calendar(panel, extra_holidays, day_type_override)
    out = cal.calendar_parts(out)
    out = cal.season_flags(out)
    # Date-ordered windows first (they share one sort), the per-series
    # unordered means next, the (month, weekday, year)-ordered mean last.
    out = demand_lags(out, by=lag_by, keys=keys)
    if S.GAS_DEMAND in out.columns and S.SOLAR_MAX in out.columns:
        out = gas_features(out, keys=keys)
    out = sc.cooling_intensity(out) if (S.FEELS_LIKE in out.columns or
                                        S.TEMP_HIGH in out.columns) else out
    out = sc.heating_intensity(out)
    out = sc.diurnal_range(out)
    out = last_year_dow_mean(out, mode=last_year_mode, keys=keys)
    # The one-hots follow the date: a supplied weekday text (any language or
    # spelling) cannot leave a row with no weekday set.
    out = out.withColumn(S.WEEKDAY_NAME, cal.weekday_name_expr(S.DATE))
    out = cal.weekday_one_hot(out, drop_source=True)
    return sc.drop_essential_nulls(out)
