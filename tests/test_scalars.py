"""Edge rows for coercion, calendar and scalar features (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from loadcast import schema as S
from loadcast.functions import calendar as cal
from loadcast.functions import scalars as sc
from loadcast.sources import ingest as io


def test_coercion_keeps_only_plain_numbers(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(
        ["1,234", "", "NaN", "1d", " 1.5 ", "abc", None, "-2e3", ".5"])], "i int, v string")
    got = rows(io.coerce_numeric(df, ["v", "absent"]), ["i"])
    assert [r["v"] for r in got] == [None, None, None, None, 1.5, None, None, -2000.0, 0.5]


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-13-01",), (None,), ("2024/02/03",),
                                ("2024-03-04T10:11:12",), ("20240506",)], "date string")
    got = [r["date"] for r in io.coerce_date(df).collect()]
    assert got == [dt.date(2024, 1, 5), None, None, dt.date(2024, 2, 3), dt.date(2024, 3, 4),
                   dt.date(2024, 5, 6)]


def test_day_type_synonyms_and_fallback(spark):
    # 2024-01-01 is a holiday (Monday), 2024-01-02 a Tuesday, 2024-01-06 a Saturday.
    data = [(dt.date(2024, 1, 2), " Weekday "), (dt.date(2024, 1, 6), "근무일"),
            (dt.date(2024, 1, 2), "주말"), (dt.date(2024, 1, 6), "???"),
            (dt.date(2024, 1, 1), None), (dt.date(2024, 1, 2), None)]
    df = spark.createDataFrame(data, "date date, day_type string")
    out = cal.prepare_calendar(df)
    got = [r["day_type"] for r in out.collect()]
    assert got == ["weekday", "weekday", "holiday", "holiday", "holiday", "weekday"]


def test_weekday_monday_is_zero_and_names(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),)], "date date")
    got = cal.with_weekday(df).collect()
    assert [(r.weekday_num, r.weekday_name) for r in got] == [(0, "Monday"), (6, "Sunday")]


def test_one_hot_null_is_all_zero_and_source_dropped(spark):
    df = spark.createDataFrame([("Monday",), (None,)], "weekday_name string")
    out = cal.weekday_one_hot(df)
    assert S.WEEKDAY_NAME not in out.columns
    got = out.collect()
    assert got[0]["dow_monday"] == 1 and sum(got[0][c] for c in S.DOW_COLUMNS) == 1
    assert sum(got[1][c] for c in S.DOW_COLUMNS) == 0


def test_temperature_floor_season_and_null(spark):
    data = [(dt.date(2024, 7, 1), t) for t in (None, 24.0, 25.0, 31.0)] + \
           [(dt.date(2024, 1, 1), t) for t in (None, 24.0, 25.0, 31.0)]
    df = spark.createDataFrame(data, "date date, feels_like double")
    df = df.withColumn(S.TEMP_LOW, F.col(S.FEELS_LIKE) - 20)
    df = cal.season_flags(cal.calendar_parts(df))
    out = sc.heating_intensity(sc.cooling_intensity(df)).collect()
    assert [r[S.COOLING] for r in out] == [None, 0.0, 0.0, 6.0, None, 0.0, 0.0, 0.0]
    # heating: 10 - low floored at 0, only in winter
    assert [r[S.HEATING] for r in out] == [None, 0.0, 0.0, 0.0, None, 6.0, 5.0, 0.0]


def test_cooling_falls_back_to_temp_high(spark):
    df = spark.createDataFrame([(dt.date(2024, 7, 1), 30.0)], "date date, temp_high double")
    df = cal.season_flags(cal.calendar_parts(df))
    assert sc.cooling_intensity(df).first()[S.COOLING] == 5.0


def test_ratios_zero_or_null_demand_give_zero(spark):
    df = spark.createDataFrame([(0.0, 5.0), (None, 5.0), (100.0, 25.0)],
                               "max_demand double, solar_max double")
    got = sc.residual_and_ratios(df).collect()
    assert [r[S.SOLAR_RATIO] for r in got] == [0.0, 0.0, 0.25]
    assert [r[S.RESIDUAL_RATIO] for r in got] == [0.0, 0.0, 0.75]


def test_gas_budget_null_stays_null_and_floors(spark):
    df = spark.createDataFrame([(100.0, 0.5, 80.0), (None, 0.5, 1.0), (100.0, 0.5, 10.0)],
                               "d double, r double, s double")
    got = df.select(sc.gas_budget_expr(F.col("d"), F.col("r"), F.col("s")).alias("b")).collect()
    assert [r.b for r in got] == [0.0, None, 40.0]


def test_align_features_fills_orders_and_drops(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, extra double")
    out = sc.align_features(df, ["b", "missing", "a"])
    assert out.columns == ["b", "missing", "a"]
    assert tuple(out.first()) == (2.0, 0.0, 1.0)


def test_clip_and_confidence(spark):
    df = spark.createDataFrame([(-5.0, 10.0, None), (50.0, 10.0, 0.9), (None, 10.0, 0.3)],
                               "p double, d double, r2 double")
    got = df.select(sc.clip_prediction(F.col("p"), F.col("d")).alias("c"),
                    sc.confidence_score(F.col("r2")).alias("k")).collect()
    assert [r.c for r in got] == [0.0, 10.0, None]
    assert [r.k for r in got] == [60.0, 90.0, 60.0]


def test_fallback_temperatures_by_season(spark):
    df = spark.createDataFrame(
        [(None, None, None, 1.0, 30.0, None, 1, 0), (None, None, None, 1.0, 30.0, None, 0, 1),
         (None, None, None, None, None, None, 0, 1), (5.0, None, None, 1.0, 30.0, 7.0, 0, 1)],
        "ol double, oh double, of double, il double, ih double, fi double, su int, wi int")
    cols = sc.fallback_temperatures(*[F.col(c) for c in
                                      ("ol", "oh", "of", "il", "ih", "fi", "su", "wi")])
    got = df.select(*[c.alias(n) for n, c in cols.items()]).collect()
    assert (got[0].temp_low, got[0].temp_high, got[0].feels_like) == (None, 30.0, 30.0)
    assert (got[1].temp_low, got[1].temp_high, got[1].feels_like) == (1.0, None, 1.0)
    assert got[2].feels_like == 0.0
    assert (got[3].temp_low, got[3].feels_like) == (5.0, 7.0)


def test_business_day_override(spark):
    df = spark.createDataFrame([(1, 1, "weekday"), (0, 1, "holiday"), (0, 0, "weekday"),
                                (0, 1, None)], "h int, b int, t string")
    got = df.select(cal.business_day_override(F.col("h"), F.col("b"), F.col("t")).alias("x"))
    assert [r.x for r in got.collect()] == [0, 0, 1, 1]


def test_fixed_holidays(spark):
    df = spark.createDataFrame([(dt.date(2024, 8, 15),), (dt.date(2024, 8, 16),)], "date date")
    assert [r.is_holiday for r in cal.with_holiday_flag(df).collect()] == [1, 0]
    extra = spark.createDataFrame([(dt.date(2024, 8, 16), "substitute")], "date date, name string")
    out = cal.with_holiday_flag(df, extra_holidays=extra)
    assert sorted(r.is_holiday for r in out.collect()) == [1, 1]


def test_dates_with_a_time_part_or_short_parts(spark):
    want = {"2024-01-05 00:00:00": 5, "2024-01-05T00:00:00.000": 5, "2024-1-5": 5,
            "2024-01-05T23:59:59.123456Z": 5, "2024/1/05 07:30": 5, "20240105": 5,
            "2024-01-05T00:00:00+09:00": 5, " 2024.01.05 ": 5, "2024-01-05x": None, "2024-13-05": None,
            "2024-02-30": None, "05-01-2024": None, "": None}
    df = spark.createDataFrame([(k,) for k in want], "date string")
    got = {r.text: r.date for r in io.coerce_date(df.selectExpr("date text", "date"), "date").collect()}
    assert {k: v and v.day for k, v in got.items()} == want


def test_extra_holidays_flag_moving_dates(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2024, 2, 9),), (dt.date(2024, 2, 13),)], "date date")
    extra = spark.createDataFrame([(dt.date(2024, 2, 9),), (None,)], "date date")
    flags = lambda e: [r.is_holiday for r in cal.with_holiday_flag(df, extra_holidays=e).orderBy("date").collect()]
    assert flags(extra) == [1, 0] and flags(extra.limit(0)) == [0, 0]
