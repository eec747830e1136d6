"""Forecast feature rows on hand-made history, the empty-source guard, and the
driver contract of __spark_entry__."""

import datetime as dt

import pytest

from loadcast import schema as S
from loadcast.plans import forecast as fc
from loadcast.sources import ingest as io


def _history(spark):
    rows = []
    d0 = dt.date(2024, 6, 3)  # a Monday in summer
    for i in range(21):
        d = d0 + dt.timedelta(days=i)
        rows.append(("s", d, 100.0 + i, 30.0, 20.0, 31.0,
                     "holiday" if d == dt.date(2024, 6, 20) else None))
    return spark.createDataFrame(
        rows, "series_id string, date date, max_demand double, temp_high double, "
              "temp_low double, feels_like double, day_type string")


def test_demand_feature_rows_lookups_and_overrides(spark):
    hist = _history(spark)
    targets = spark.createDataFrame(
        [("s", dt.date(2024, 6, 20), None, None, None),      # observed temps, day type supplied
         ("s", dt.date(2024, 6, 24), 18.0, 33.0, None)],      # future: supplied temps
        "series_id string, date date, in_low double, in_high double, in_feels double")
    got = {r.date: r for r in fc.demand_feature_rows(targets, hist).collect()}
    a = got[dt.date(2024, 6, 20)]
    assert a[S.DEMAND_LAG1] == 100.0 + 16          # latest value before the 20th
    assert a[S.DEMAND_LAG7] == 100.0 + 10          # exact date - 7
    assert a[S.TEMP_HIGH] == 30.0 and a[S.FEELS_LIKE] == 31.0
    assert a[S.IS_BUSINESS_DAY] == 0               # supplied 'holiday' overrides a Thursday
    assert a[S.COOLING] == 6.0                     # feels_like 31 in June
    assert a["dow_thursday"] == 1
    b = got[dt.date(2024, 6, 24)]
    assert b[S.DEMAND_LAG1] == 120.0               # last observed day
    assert b[S.DEMAND_LAG7] == 100.0 + 14          # 2024-06-17 exists
    assert b[S.TEMP_HIGH] == 33.0                  # summer: supplied high accepted
    assert b[S.TEMP_LOW] == 0.0                    # summer: supplied low ignored -> 0
    assert b[S.FEELS_LIKE] == 33.0                 # no feels-like: falls back to high
    assert b[S.IS_BUSINESS_DAY] == 1


def test_read_table_rejects_empty_source(spark, tmp_path):
    p = tmp_path / "empty.csv"
    p.write_text("date,max_demand\n")
    with pytest.raises(ValueError):
        io.read_table(spark, str(p))


def test_entry_contract(spark):
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 60
    df = E.entry(spark)
    assert df.columns == ["series_id", "month", "is_business_day", "n_days", "avg_demand",
                          "mae_lag1", "mae_lag7"]
    assert df.count() > 0
