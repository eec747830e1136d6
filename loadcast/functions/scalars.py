"""Row-local feature expressions: temperatures, ratios, budgets, clipping.

Spark's ``greatest``/``least`` skip nulls (``greatest(null, 0) = 0``), while a
missing input must stay missing here, so every floor/clip guards nulls first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast import schema as S


def floor_zero(x: Column) -> Column:
    """max(x, 0) with null kept null."""
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(x, F.lit(0.0)))


def cooling_intensity(df: DataFrame, base: float = S.COOLING_BASE) -> DataFrame:
    """max(0, t - base) in summer, 0 otherwise; t = feels_like, else temp_high."""
    if S.FEELS_LIKE in df.columns:
        t = F.col(S.FEELS_LIKE)
    elif S.TEMP_HIGH in df.columns:
        t = F.col(S.TEMP_HIGH)
    else:
        raise ValueError("cooling intensity needs feels_like or temp_high")
    return df.withColumn(S.COOLING, floor_zero(t - F.lit(base)) * F.col(S.IS_SUMMER))


def heating_intensity(df: DataFrame, base: float = S.HEATING_BASE) -> DataFrame:
    """max(0, base - temp_low) in winter; 0 when temp_low is absent."""
    if S.TEMP_LOW not in df.columns:
        return df.withColumn(S.HEATING, F.lit(0.0))
    return df.withColumn(
        S.HEATING, floor_zero(F.lit(base) - F.col(S.TEMP_LOW)) * F.col(S.IS_WINTER))


def diurnal_range(df: DataFrame) -> DataFrame:
    """temp_high - temp_low when both columns exist."""
    if S.TEMP_HIGH in df.columns and S.TEMP_LOW in df.columns:
        return df.withColumn(S.DIURNAL, F.col(S.TEMP_HIGH) - F.col(S.TEMP_LOW))
    return df


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den with a zero or null denominator (or null numerator) giving 0."""
    return F.coalesce(F.try_divide(num, F.nullif(den, F.lit(0.0))), F.lit(0.0))


def residual_and_ratios(df: DataFrame) -> DataFrame:
    """B14 + B15: residual load and the two shares of peak demand."""
    demand, solar = F.col(S.MAX_DEMAND), F.col(S.SOLAR_MAX)
    out = df.withColumn(S.RESIDUAL_LOAD, demand - solar)
    return out.withColumns({
        S.SOLAR_RATIO: safe_ratio(solar, demand),
        S.RESIDUAL_RATIO: safe_ratio(F.col(S.RESIDUAL_LOAD), demand),
    })


def gas_budget_expr(demand: Column, ratio: Column, solar: Column) -> Column:
    """max(0, demand * ratio - solar), null kept null (floored at forecast too)."""
    return floor_zero(demand * ratio - solar)


def fill_lags(df: DataFrame, cols: list[str] | None = None, value: float = 0.0) -> DataFrame:
    """Null lags -> 0 before training."""
    cols = [c for c in (cols or S.LAG_COLUMNS) if c in df.columns]
    return df.fillna(value, subset=cols)


def drop_essential_nulls(df: DataFrame) -> DataFrame:
    """Drop rows with null max_demand or month (run after the lags)."""
    subset = [c for c in (S.MAX_DEMAND, S.MONTH) if c in df.columns]
    return df.na.drop(subset=subset) if subset else df


def complete_cases(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Keep rows with no null in any feature nor in the target.

    NaN counts as missing too (the reference works on float NaN).
    """
    cond = F.lit(True)
    for c in features + [target]:
        col = F.col(c)
        cond = cond & col.isNotNull() & ~F.isnan(col.cast("double"))
    return df.where(cond)


def align_features(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Training order restored, missing features as 0.0, extras dropped."""
    keep = [c for c in (keep or []) if c in df.columns]
    cols = [F.col(n) if n in df.columns else F.lit(0.0).alias(n) for n in names]
    return df.select(*keep, *cols)


def fallback_temperatures(obs_low: Column, obs_high: Column, obs_feels: Column,
                          in_low: Column, in_high: Column, in_feels: Column,
                          is_summer: Column, is_winter: Column) -> dict[str, Column]:
    """Observed value first; else the supplied one if the season fits.

    low takes the supplied value only in winter, high only in summer; the
    supplied feels-like is always accepted. With no feels-like at all, it falls
    back to high (summer), low (winter) or the mean of the two (missing as 0).
    """
    low = F.coalesce(obs_low, F.when(is_winter == 1, in_low))
    high = F.coalesce(obs_high, F.when(is_summer == 1, in_high))
    feels0 = F.coalesce(obs_feels, in_feels)
    feels = F.coalesce(
        feels0,
        F.when((is_summer == 1) & high.isNotNull(), high),
        F.when((is_winter == 1) & low.isNotNull(), low),
        (F.coalesce(low, F.lit(0.0)) + F.coalesce(high, F.lit(0.0))) / 2.0,
    )
    return {S.TEMP_LOW: low.cast("double"), S.TEMP_HIGH: high.cast("double"),
            S.FEELS_LIKE: feels.cast("double")}


def clip_prediction(pred: Column, demand: Column) -> Column:
    """0 <= gas <= demand; a null prediction stays null."""
    return F.when(pred.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(0.0), F.least(pred, demand)))


def confidence_score(r2: Column) -> Column:
    """min(95, max(60, 100 * R2)); 60 when there is no R2."""
    return F.least(F.lit(95.0), F.greatest(F.lit(60.0), r2 * 100.0))


def gas_rate(last: Column, prev: Column) -> Column:
    """F8: (last - prev) / prev, 0 when either is missing or prev = 0."""
    return F.coalesce(F.try_divide(last - prev, F.nullif(prev, F.lit(0.0))), F.lit(0.0))
