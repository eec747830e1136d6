"""Change sets by digests, saving by period, and the moving holidays."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.functions import calendar as cal, lunar
from loadcast.operators import changes as ch, incremental as inc

COLS = "k int, day date, a string, b double"


def table(spark, rows):
    return spark.createDataFrame(rows, COLS).withColumn("month", F.date_format("day", "yyyy-MM"))


def base_rows(n=400):
    return [(k, dt.date(2024, 1 + k % 5, 1 + k % 28), None if k % 7 == 0 else f"a{k}", float(k) if k % 5 else None) for k in range(n)]


def edited_rows():
    out = {r[0]: r for r in base_rows()}
    out[3] = (3, *out[3][1:3], 99.0)
    out[7] = (7, out[7][1], "new", out[7][3])
    del out[9]
    out[1000] = (1000, dt.date(2024, 2, 2), None, None)
    return list(out.values())


def collected(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("edits", [edited_rows(), base_rows(), [], base_rows(10)])
def test_changes_by_digest_equal_those_of_whole_tables(spark, tmp_path, edits):
    old, new = (table(spark, rows).drop("month") for rows in (base_rows(), edits))
    path = inc.write_with_digests(old, str(tmp_path / "t"), ["k"], buckets=32, coarse=4)
    want = ch.changed_rows(new, old, ["k"])
    got = inc.changed_by_digest(new, path, ["k"], buckets=32, coarse=4)
    assert collected(got.select(*want.columns)) == collected(want)


def test_only_changed_buckets_are_read(spark, tmp_path):
    old, new = (table(spark, rows).drop("month") for rows in (base_rows(), edited_rows()))
    path = inc.write_with_digests(old, str(tmp_path / "t"), ["k"], buckets=64, coarse=8)
    cols = ["day", "a", "b"]
    found = inc.changed_buckets(new, path, ["k"], cols, 64, 8)
    keys = spark.createDataFrame([(3,), (7,), (9,), (1000,)], "k int").select(inc.bucket_of(["k"], 64)).collect()
    assert found == sorted({r[0] for r in keys})
    assert inc.changed_buckets(old, path, ["k"], cols, 64, 8) == []
    plan = inc.changed_by_digest(new, path, ["k"], buckets=64, coarse=8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan


def test_digests_see_nulls_that_change_their_column(spark):
    a, b = (spark.createDataFrame([r], "k int, a string, b string") for r in ((1, "x", None), (1, None, "x")))
    one, two = (inc.bucket_digests(d, ["k"], ["a", "b"], 4).collect() for d in (a, b))
    assert one != two


def parts(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("month=")}


def edits_of(spark, edits):
    old = table(spark, base_rows())
    return ch.changed_rows(table(spark, edits), old, ["k"])


@pytest.mark.parametrize("ends", ["before the list", "after staging", "midway", "never"])
def test_saving_rewrites_touched_periods_and_survives_an_end_midway(spark, tmp_path, ends):
    path = inc.write_by_period(table(spark, base_rows()), str(tmp_path / "t"), "month")
    before = parts(path)
    rows = {r[0]: r for r in base_rows() if r[1].month != 4}     # all of April goes
    rows[3] = (3, dt.date(2024, 2, 28), "moved", 1.0) if 3 in rows else rows.get(3)
    rows[1] = (1, dt.date(2024, 3, 9), "moved", 2.0)              # from February to March
    rows = {k: r for k, r in rows.items() if r}
    changes = edits_of(spark, list(rows.values()))
    if ends != "never":
        inc.stage_changes(path, changes, ["k"], "month", "day")
        if ends == "before the list":
            shutil.rmtree(f"{path}_pending/touched")
        if ends == "midway":
            shutil.rmtree(f"{path}/month=2024-02")                # deleted, not yet put in place
    if ends == "midway":
        assert inc.settle(spark, path, "month") and not inc.settle(spark, path, "month")
    inc.write_changes(path, changes, ["k"], "month", "day")
    after = parts(path)
    want = table(spark, list(rows.values()))
    got = spark.read.parquet(path).select(*want.columns)
    assert collected(got) == collected(want)
    assert "month=2024-04" not in after and not os.path.exists(f"{path}_pending")
    assert {m for m in before if before[m] == after.get(m)} == {"month=2024-01", "month=2024-05"}


# --- moving holidays ----------------------------------------------------------------

# Published dates: Lunar New Year, Buddha's Birthday, Mid-Autumn Festival.
PUBLISHED = """
2008-02-07 2008-05-12 2008-09-14
2009-01-26 2009-05-02 2009-10-03
2010-02-14 2010-05-21 2010-09-22
2011-02-03 2011-05-10 2011-09-12
2012-01-23 2012-05-28 2012-09-30
2013-02-10 2013-05-17 2013-09-19
2014-01-31 2014-05-06 2014-09-08
2015-02-19 2015-05-25 2015-09-27
2016-02-08 2016-05-14 2016-09-15
2017-01-28 2017-05-03 2017-10-04
2018-02-16 2018-05-22 2018-09-24
2019-02-05 2019-05-12 2019-09-13
2020-01-25 2020-04-30 2020-10-01
2021-02-12 2021-05-19 2021-09-21
2022-02-01 2022-05-08 2022-09-10
2023-01-22 2023-05-27 2023-09-29
2024-02-10 2024-05-15 2024-09-17
2025-01-29 2025-05-05 2025-10-06
2026-02-17 2026-05-24 2026-09-25
2027-02-07 2027-05-13 2027-09-15
"""
SUBSTITUTES = """
2014-09-10 2015-09-29 2016-02-10 2017-01-30 2017-10-06 2018-05-07 2018-09-26 2019-05-06 2020-01-27 2021-08-16
2021-10-04 2021-10-11 2022-09-12 2022-10-10 2023-01-24 2023-05-29 2024-02-12 2024-05-06 2025-03-03 2025-05-06
2025-10-08 2026-03-02 2026-05-25 2026-08-17 2026-10-05 2027-02-09 2027-08-16 2027-10-04 2027-10-11 2027-12-27
"""


def test_lunar_dates_and_substitute_days_as_published():
    for line in PUBLISHED.split("\n")[1:-1]:
        year = int(line[:4])
        assert [lunar.lunar_date(year, *d).isoformat() for d in ((1, 1), (4, 8), (8, 15))] == line.split()
    made = [d.isoformat() for year in range(2008, 2028) for d, name in lunar.moving_holidays(year) if name == "Substitute"]
    assert made == SUBSTITUTES.split()
    for year in range(lunar.FIRST_YEAR, lunar.LAST_YEAR + 1):
        new_year = lunar.lunar_date(year, 1, 1)
        assert (1, 20) <= (new_year.month, new_year.day) <= (2, 22)


def test_the_calendar_step_knows_moving_holidays(spark):
    days = ["2024-02-09", "2024-02-12", "2024-02-13", "2024-04-10", "2024-05-05", "2024-05-06", "2024-05-15", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias(S.DATE))
    flags = {str(r.date): r.is_holiday for r in cal.prepare_calendar(df).collect()}
    assert flags == dict(zip(map(str, days), [1, 1, 0, 1, 1, 1, 1, 0]))
    assert sum(r.is_holiday for r in cal.prepare_calendar(df, moving_holidays=False).collect()) == 1
    named = {str(r.date): r["name"] for r in cal.moving_holiday_calendar(df).collect()}
    assert named["2024-02-12"] == "Substitute" and named["2024-09-17"] == "Mid-Autumn Festival" and len(named) == 11
