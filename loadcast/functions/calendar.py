"""Calendar expressions: parts, weekday, holidays, business days, day type.

All of these are row-local Catalyst expressions (no shuffle). Fixed-date
holidays are an expression on (month, day), moving ones (lunar festivals,
substitute and one-off days, ``functions.lunar``) a look-up in a set of day
numbers bounded by the calendar. Only a user-supplied holiday table needs a
join, broadcast behind a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.functions import lunar
from loadcast.operators.joins import broadcast_if_small


def calendar_parts(df: DataFrame, date_col: str = S.DATE) -> DataFrame:
    """Year, month, day of month."""
    d = F.col(date_col)
    return df.withColumns({
        S.YEAR: F.year(d),
        S.MONTH: F.month(d),
        S.DAY: F.dayofmonth(d),
    })


def weekday_num(date_col: str = S.DATE) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(F.col(date_col))


def weekday_name_expr(date_col: str = S.DATE) -> Column:
    names = F.array(*[F.lit(n) for n in S.WEEKDAY_NAMES])
    return F.element_at(names, weekday_num(date_col) + 1)


def with_weekday(df: DataFrame, date_col: str = S.DATE) -> DataFrame:
    """Weekday number always; weekday name only when the column is absent."""
    out = df.withColumn(S.WEEKDAY_NUM, weekday_num(date_col))
    if S.WEEKDAY_NAME not in df.columns:
        out = out.withColumn(S.WEEKDAY_NAME, weekday_name_expr(date_col))
    return out


def fixed_holiday_expr(date_col: str = S.DATE) -> Column:
    """1 when (month, day) is a fixed-date public holiday, else 0; null date -> 0."""
    d = F.col(date_col)
    md = F.month(d) * 100 + F.dayofmonth(d)
    codes = [m * 100 + day for m, day, _ in S.FIXED_DATE_HOLIDAYS]
    return F.coalesce(md.isin(codes), F.lit(False)).cast("int")


def moving_holiday_expr(date_col: str = S.DATE, first: int = lunar.FIRST_YEAR, last: int = lunar.LAST_YEAR) -> Column:
    """1 on lunar festivals, substitute days and one-off days of the years ``first`` to ``last``, else 0; null date -> 0."""
    days = ", ".join(str(d.toordinal() - 719163) for d in lunar.moving_dates(first, last))
    return F.coalesce(F.expr(f"unix_date(cast(`{date_col}` as date)) in ({days})"), F.lit(False)).cast("int")


def moving_holiday_calendar(dates: DataFrame, date_col: str = S.DATE) -> DataFrame:
    """Moving holidays ``(date, name)`` of every calendar year found in ``dates``, within the years that are known.

    The table it is taken from has some ten rows a year, whatever the data.
    """
    rows = [(d, name) for year in range(lunar.FIRST_YEAR, lunar.LAST_YEAR + 1) for d, name in lunar.moving_holidays(year)]
    table = dates.sparkSession.createDataFrame(rows, "date date, name string")
    years = dates.select(F.year(date_col).alias("_y")).where("_y is not null").distinct()
    return years.join(F.broadcast(table), F.year("date") == F.col("_y")).select(F.col("date").alias(S.DATE), "name")


def holiday_calendar(dates: DataFrame, date_col: str = S.DATE) -> DataFrame:
    """Holiday dimension ``(date, name)`` for every calendar year found in ``dates``.

    The output holds at most len(FIXED_DATE_HOLIDAYS) rows per distinct year,
    so its size is bounded by the calendar, not by the data.
    """
    years = dates.select(F.year(date_col).alias("y")).where("y is not null").distinct()
    entries = F.array(*[
        F.struct(F.make_date(F.col("y"), F.lit(m), F.lit(day)).alias(S.DATE),
                 F.lit(name).alias("name"))
        for m, day, name in S.FIXED_DATE_HOLIDAYS
    ])
    return years.select(F.inline(entries))


def with_holiday_flag(df: DataFrame, date_col: str = S.DATE,
                      extra_holidays: DataFrame | None = None,
                      max_broadcast_rows: int = 1_000_000,
                      extra_is_bounded: bool = False, moving: bool = False) -> DataFrame:
    """``is_holiday`` = fixed-date holiday or a date of ``extra_holidays``.

    With ``moving`` lunar festivals, substitute days and one-off days count too.
    ``extra_holidays`` (date column ``date``) is deduplicated and joined left;
    it is broadcast only when its row count is under ``max_broadcast_rows``,
    otherwise Spark plans a shuffle join. ``extra_is_bounded=True`` skips the
    count for tables bounded by construction (e.g. :func:`holiday_calendar`).
    """
    flag = fixed_holiday_expr(date_col)
    if moving:
        flag = F.greatest(flag, moving_holiday_expr(date_col))
    if extra_holidays is None:
        return df.withColumn(S.IS_HOLIDAY, flag)
    marks = (extra_holidays.select(F.col(S.DATE).cast("date").alias("_hday"))
             .where("_hday is not null").distinct()
             .withColumn("_hmark", F.lit(1)))
    marks = F.broadcast(marks) if extra_is_bounded else broadcast_if_small(
        marks, max_broadcast_rows)
    joined = df.join(marks, F.col(date_col) == F.col("_hday"), "left")
    return (joined
            .withColumn(S.IS_HOLIDAY,
                        F.greatest(flag, F.coalesce(F.col("_hmark"), F.lit(0))).cast("int"))
            .drop("_hday", "_hmark"))


def business_day_expr(date_col: str = S.DATE, holiday_col: str = S.IS_HOLIDAY) -> Column:
    """Weekday < 5 and not a holiday, as 0/1."""
    return ((weekday_num(date_col) < 5) & (F.col(holiday_col) == 0)).cast("int")


def with_business_day(df: DataFrame, date_col: str = S.DATE) -> DataFrame:
    return df.withColumn(S.IS_BUSINESS_DAY, business_day_expr(date_col))


def derived_day_type(business_col: str = S.IS_BUSINESS_DAY) -> Column:
    """``weekday`` for business days, else ``holiday``."""
    return (F.when(F.col(business_col) == 1, F.lit(S.DAY_TYPE_WEEKDAY))
            .otherwise(F.lit(S.DAY_TYPE_HOLIDAY)))


def normalize_day_type(df: DataFrame, col: str = S.DAY_TYPE,
                       business_col: str = S.IS_BUSINESS_DAY) -> DataFrame:
    """B7 + B8: day type reduced to ``weekday`` / ``holiday``.

    A supplied value is trimmed and lower-cased and mapped through the synonym
    lists; anything else (unknown text, null, or no column at all) takes the
    value derived from the business-day flag.
    """
    derived = derived_day_type(business_col)
    if col not in df.columns:
        return df.withColumn(col, derived)
    key = F.lower(F.trim(F.col(col)))
    mapped = (F.when(key.isin(S.DAY_TYPE_WEEKDAY_SYNONYMS), F.lit(S.DAY_TYPE_WEEKDAY))
              .when(key.isin(S.DAY_TYPE_HOLIDAY_SYNONYMS), F.lit(S.DAY_TYPE_HOLIDAY)))
    return df.withColumn(col, F.coalesce(mapped, derived))


def one_hot(df: DataFrame, col: str, values: list[str], prefix: str,
            drop_source: bool = True) -> DataFrame:
    """One 0/1 column per listed value (none dropped); null -> all zero.

    The value list is fixed up front (e.g. the seven weekday names) so the
    output schema never depends on the data and no pass over it is needed.
    """
    c = F.col(col)
    out = df.withColumns({
        prefix + v.lower(): F.coalesce((c == F.lit(v)), F.lit(False)).cast("int")
        for v in values
    })
    return out.drop(col) if drop_source else out


def weekday_one_hot(df: DataFrame, drop_source: bool = True) -> DataFrame:
    return one_hot(df, S.WEEKDAY_NAME, S.WEEKDAY_NAMES, S.DOW_PREFIX, drop_source)


def season_flags(df: DataFrame, month_col: str = S.MONTH) -> DataFrame:
    """summer = May..September, winter = every other month."""
    m = F.col(month_col)
    return df.withColumns({
        S.IS_SUMMER: m.isin(S.SUMMER_MONTHS).cast("int"),
        S.IS_WINTER: m.isin(S.WINTER_MONTHS).cast("int"),
    })


def business_day_override(is_holiday: Column, derived_business: Column,
                          supplied_day_type: Column) -> Column:
    """A supplied day type decides the business flag unless it is a holiday.

    The supplied text goes through the same synonym lists as B8; text that
    matches neither list (or null) leaves the flag derived from the date.
    """
    key = F.lower(F.trim(supplied_day_type))
    supplied = (F.when(key.isin(S.DAY_TYPE_WEEKDAY_SYNONYMS), F.lit(1))
                .when(key.isin(S.DAY_TYPE_HOLIDAY_SYNONYMS), F.lit(0)))
    return (F.when(is_holiday == 1, F.lit(0))
            .otherwise(F.coalesce(supplied, derived_business)).cast("int"))


def prepare_calendar(df: DataFrame, extra_holidays: DataFrame | None = None,
                     day_type_override: bool = False, moving_holidays: bool = True) -> DataFrame:
    """Step 1 of the reference flow: weekday, holiday, business day, day type.

    With ``day_type_override`` a supplied day type decides the business flag
    (B26). Training and both forecasts come through here, with one flag and
    with moving holidays.
    """
    out = with_weekday(df)
    out = with_holiday_flag(out, extra_holidays=extra_holidays, moving=moving_holidays)
    out = with_business_day(out)
    if day_type_override and S.DAY_TYPE in out.columns:
        out = out.withColumn(S.IS_BUSINESS_DAY, business_day_override(
            F.col(S.IS_HOLIDAY), F.col(S.IS_BUSINESS_DAY), F.col(S.DAY_TYPE)))
    return normalize_day_type(out)
