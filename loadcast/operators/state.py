"""Model state kept between runs and brought up to date from a change set.

Three small tables stand for the history a forecast looks at:

* ``month_weekday``: sum and count of the peak demand per series, year, month
  and weekday (D1);
* ``day_kind``: sum and count of the total ratio per series and kind of day (D2);
* ``recent``: of each series and month the last rows that the lags can reach
  (C5, C6).

The first two are additive: new state = state - old rows + new rows, one
aggregation of the state and the changed rows, none of the history. Sums are
decimals, so an updated state equals the one computed afresh to the last
digit. ``recent`` is rebuilt for the touched months of the touched series only.

Null and NaN values count as rows without a value. A cell whose last row is
gone is dropped. A series and date is held once, as in any daily table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.functions import calendar as cal
from loadcast.operators import features as fe
from loadcast.operators import lookup as lk
from loadcast.operators.changes import DELETE, INSERT, UPDATE

# Digits behind the point that the sums keep; a value is rounded to them before it is added.
DEMAND_DIGITS, RATIO_DIGITS = 6, 15
# The lags reach the 7 latest demands and the 2 latest usable gas values.
DEMAND_ROWS, GAS_ROWS = 7, 2
PERIOD = "period"
RECENT = [S.SERIES, S.DATE, S.MAX_DEMAND, S.GAS_DEMAND, S.SOLAR_MAX]


@dataclass(frozen=True)
class Additive:
    """Sum, count of values and count of rows per cell of ``keys``."""

    keys: tuple[str, ...]
    digits: int

    def value(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def signed(self, df: DataFrame, sign: int) -> DataFrame:
        v = self.value(df).cast("double")
        exact = F.when(~F.isnan(v), v).cast(f"decimal(28,{self.digits})")
        return df.select(*self.keys, (exact * sign).cast(f"decimal(38,{self.digits})").alias("total"),
                         F.when(exact.isNotNull(), sign).otherwise(0).cast("long").alias("n"),
                         F.lit(sign).cast("long").alias("n_rows"))

    def merged(self, parts: DataFrame) -> DataFrame:
        total = F.coalesce(F.sum("total"), F.lit(0)).cast(f"decimal(38,{self.digits})")
        return (parts.groupBy(*self.keys).agg(total.alias("total"), F.sum("n").alias("n"),
                                              F.sum("n_rows").alias("n_rows")).where("n_rows != 0"))

    def fresh(self, rows: DataFrame) -> DataFrame:
        """The state of ``rows`` with their calendar columns."""
        return self.merged(self.signed(rows, 1))

    def update(self, state: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
        """``state`` without the rows ``removed`` and with the rows ``added``."""
        return self.merged(state.select(*self.keys, "total", "n", "n_rows")
                           .unionByName(self.signed(removed, -1)).unionByName(self.signed(added, 1)))


class MonthWeekday(Additive):
    def value(self, df):
        return df[S.MAX_DEMAND]


class DayKind(Additive):
    def value(self, df):
        return fe.total_ratio(df)


MONTH_WEEKDAY = MonthWeekday((S.SERIES, S.YEAR, S.MONTH, S.WEEKDAY_NUM), DEMAND_DIGITS)
DAY_KIND = DayKind((S.SERIES, S.IS_BUSINESS_DAY), RATIO_DIGITS)


def month_weekday_means(state: DataFrame) -> DataFrame:
    """The D1 table from its state; the columns of ``features.month_weekday_table``."""
    mean = F.col("total").cast("double") / F.nullif(F.col("n"), F.lit(0))
    return state.select(*MONTH_WEEKDAY.keys, mean.alias("mean_max_demand"), F.col("n").alias("n_days"))


def ratio_means(state: DataFrame) -> DataFrame:
    """The D2 table from its state; the columns of ``features.ratio_means_table``."""
    def mean(where: Column) -> Column:
        n = F.sum(F.when(where, F.col("n")))
        return F.sum(F.when(where, F.col("total"))).cast("double") / F.nullif(n, F.lit(0))

    bd, zero = F.col(S.IS_BUSINESS_DAY), F.lit(0.0)
    agg = state.groupBy(S.SERIES).agg(mean(bd == 1).alias("_b"), mean(bd == 0).alias("_o"),
                                      mean(F.lit(True)).alias("_all"))
    return agg.select(S.SERIES, F.coalesce("_b", "_all", zero).alias("ratio_business"),
                      F.coalesce("_o", "_all", zero).alias("ratio_other"),
                      F.coalesce("_all", zero).alias("ratio_overall"))


# --- the last rows ------------------------------------------------------------------

def period_of(date: Column | str) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def last_rows(rows: DataFrame) -> DataFrame:
    """Per series and month the rows that may be among the latest of the series.

    A window holds one month of one daily series, 31 rows at most.
    """
    latest = Window.partitionBy(S.SERIES, PERIOD).orderBy(F.col(S.DATE).desc())
    usable = F.col(S.GAS_DEMAND).isNotNull() & F.col(S.SOLAR_MAX).isNotNull()
    has = F.col(S.MAX_DEMAND).isNotNull()
    ranked = rows.withColumn(PERIOD, period_of(S.DATE)).select(
        *RECENT, PERIOD, F.sum(has.cast("int")).over(latest).alias("_d"),
        F.sum(usable.cast("int")).over(latest).alias("_g"))
    return ranked.where((has & (F.col("_d") <= DEMAND_ROWS)) | (usable & (F.col("_g") <= GAS_ROWS))) \
        .select(*RECENT, PERIOD)


def update_last_rows(state: DataFrame, table: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """``state`` with the touched months of the touched series rebuilt from ``table``.

    ``table`` is the changed table. It is cut to the dates from the first to
    the last touched day's month before it is joined, so that a table by date
    or period reads these only.
    """
    touched = (removed.select(S.SERIES, S.DATE).unionByName(added.select(S.SERIES, S.DATE))
               .select(S.SERIES, period_of(S.DATE).alias(PERIOD)).distinct())
    first, last = touched.agg(F.min(PERIOD), F.max(PERIOD)).first()
    if first is None:
        return state
    begin = F.make_date(F.lit(first // 12), F.lit(first % 12 + 1), F.lit(1))
    end = F.make_date(F.lit((last + 1) // 12), F.lit((last + 1) % 12 + 1), F.lit(1))
    part = table.where((F.col(S.DATE) >= begin) & (F.col(S.DATE) < end)).withColumn(PERIOD, period_of(S.DATE))
    again = last_rows(part.join(touched, [S.SERIES, PERIOD], "left_semi"))
    return state.join(touched, [S.SERIES, PERIOD], "left_anti").select(*RECENT, PERIOD).unionByName(again)


def last_two_gas(state: DataFrame) -> DataFrame:
    """C6 from the state: last and previous usable gas value of each series."""
    return lk.last_two_gas(state)


# --- from a change set --------------------------------------------------------------

def calendar_rows(df: DataFrame, extra_holidays: DataFrame | None = None,
                  day_type_override: bool = True) -> DataFrame:
    """Rows with the calendar columns that the cells are keyed by; options as in training."""
    return cal.calendar_parts(cal.prepare_calendar(df, extra_holidays, day_type_override))


def old_and_new(changes: DataFrame, old: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows a change set takes away and those it adds.

    ``changes`` holds the new values (A6, also by digests); the old ones are
    looked up in ``old`` for its updates and deletes only.
    """
    gone = changes.where(F.col("kind").isin(UPDATE, DELETE)).select(*key)
    added = changes.where(F.col("kind").isin(INSERT, UPDATE)).drop("kind", "changed")
    return old.join(gone, key, "left_semi"), added
