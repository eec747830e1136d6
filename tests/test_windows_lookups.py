"""Lags, gas change, splits, folds and lookups on hand-made frames, with
brute-force references for the as-of and last-week lookups."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from loadcast import schema as S
from loadcast.operators import features as fe
from loadcast.operators import lookup as lk
from loadcast.operators import profile as pr
from loadcast.operators import ranking as rk
from loadcast.operators import split as sp

D0 = dt.date(2024, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n - 1)


def test_gaps_row_lag_differs_from_calendar_lag(spark):
    data = [("s", day(d), float(d)) for d in (1, 2, 4, 11)]
    df = spark.createDataFrame(data, "series_id string, date date, max_demand double")
    out = df.withColumns({
        "row1": fe.lag_by_rows(S.MAX_DEMAND, 1),
        "cal1": fe.lag_by_calendar(S.MAX_DEMAND, 1),
        "cal7": fe.lag_by_calendar(S.MAX_DEMAND, 7),
    })
    got = rows(out, ["date"])
    assert [r["row1"] for r in got] == [None, 1.0, 2.0, 4.0]
    assert [r["cal1"] for r in got] == [None, 1.0, None, None]
    assert [r["cal7"] for r in got] == [None, None, None, 4.0]


def test_same_dow_last_week_precise(spark):
    hist = spark.createDataFrame([("s", day(d), float(d)) for d in range(1, 10) if d != 5],
                                 "series_id string, date date, max_demand double")
    targets = spark.createDataFrame([("s", day(12)), ("s", day(10)), ("s", day(3))],
                                    "series_id string, date date")
    got = {r["date"]: r["demand_last_week"] for r in
           lk.same_dow_last_week(targets, hist).collect()}
    # day 12: exact day 5 missing; prior values 1,2,3,4,6,7,8,9 -> 7th latest is 2
    assert got[day(12)] == 2.0
    # day 10: exact day 3 exists
    assert got[day(10)] == 3.0
    # day 3: no exact (day -4) and only 2 prior values -> 0
    assert got[day(3)] == 0.0


def test_asof_matches_brute_force(spark):
    rnd = random.Random(7)
    hist_rows, tgt_rows = [], []
    for s in ("a", "b"):
        for d in rnd.sample(range(1, 80), 30):
            hist_rows.append((s, day(d), None if rnd.random() < 0.2 else float(rnd.randint(1, 99))))
        for d in rnd.sample(range(1, 90), 25):
            tgt_rows.append((s, day(d)))
    hist = spark.createDataFrame(hist_rows, "series_id string, date date, max_demand double")
    tg = spark.createDataFrame(tgt_rows, "series_id string, date date")
    got = {(r.series_id, r.date): (r.v, r.v_date) for r in
           lk.last_before(tg, hist, S.MAX_DEMAND, out="v").collect()}
    for s, d in tgt_rows:
        prior = [(hd, v) for hs, hd, v in hist_rows if hs == s and hd < d and v is not None]
        want = max(prior) if prior else None
        assert got[(s, d)] == ((want[1], want[0]) if want else (None, None))


def test_asof_carries_other_target_columns(spark):
    hist = spark.createDataFrame([("s", day(1), 5.0)], "series_id string, date date, max_demand double")
    tg = spark.createDataFrame([("s", day(2), "x")], "series_id string, date date, tag string")
    r = lk.last_before(tg, hist, S.MAX_DEMAND).first()
    assert (r.tag, r.last_value) == ("x", 5.0)


def test_gas_change_forward_fills_and_zero_base(spark):
    vals = [10.0, None, 20.0, 0.0, 5.0]
    df = spark.createDataFrame([("s", day(i + 1), v, 1.0) for i, v in enumerate(vals)],
                               "series_id string, date date, gas_demand double, solar_max double")
    got = rows(fe.gas_lags(df), ["date"])
    assert [r[S.GAS_CHANGE_LAG1] for r in got] == [None, None, 0.0, 1.0, -1.0]
    assert [r[S.GAS_LAG1] for r in got] == [None, 10.0, None, 20.0, 0.0]
    # zero base: the value after 0 divides by zero -> null
    df2 = spark.createDataFrame([("s", day(i + 1), v, 1.0) for i, v in enumerate([0.0, 3.0, 4.0])],
                                "series_id string, date date, gas_demand double, solar_max double")
    assert [r[S.GAS_CHANGE_LAG1] for r in rows(fe.gas_lags(df2), ["date"])] == [None, None, None]


def test_split_bounds_clamped(spark):
    for n, k in [(1, 1), (2, 1), (5, 4), (10, 8)]:
        df = spark.createDataFrame([("s", day(i + 1)) for i in range(n)], "series_id string, date date")
        got = rows(sp.chronological_split(df), ["date"])
        assert sum(r["split"] == "train" for r in got) == k
        train_dates = [r["date"] for r in got if r["split"] == "train"]
        test_dates = [r["date"] for r in got if r["split"] == "test"]
        assert not test_dates or max(train_dates) < min(test_dates)


def test_expanding_folds_like_time_series_split(spark):
    n = 10
    df = spark.createDataFrame([("s", day(i + 1)) for i in range(n)], "series_id string, date date")
    got = rows(sp.expanding_folds(df), ["fold", "date"])
    for fold in range(3):
        tr = [r["date"] for r in got if r["fold"] == fold and r["role"] == "train"]
        te = [r["date"] for r in got if r["fold"] == fold and r["role"] == "test"]
        blk = n // 4
        start = n - (3 - fold) * blk
        assert tr == [day(i + 1) for i in range(start)]
        assert te == [day(i + 1) for i in range(start, start + blk)]


def test_leap_day_week_anchor(spark):
    tg = spark.createDataFrame([("s", dt.date(2024, 2, 29))], "series_id string, date date")
    hist = spark.createDataFrame([("s", dt.date(2023, 2, 28), 7.0)],
                                 "series_id string, date date, max_demand double")
    got = rows(lk.same_week_last_year(tg, hist), ["date"])
    assert [r["date"] for r in got] == [dt.date(2023, 2, 27) + dt.timedelta(days=i)
                                        for i in range(7)]
    assert [r["max_demand"] for r in got] == [None, 7.0, None, None, None, None, None]
    assert got[0]["weekday_name"] == "Monday"


def test_tail_values_and_last_two_gas(spark):
    df = spark.createDataFrame([("s", day(i), float(i), float(i) if i != 20 else None, 1.0)
                                for i in range(1, 21)],
                               "series_id string, date date, max_demand double, "
                               "gas_demand double, solar_max double")
    tail = rows(lk.tail_values(df, n=14), ["pos"])
    assert [r["max_demand"] for r in tail] == [float(i) for i in range(7, 21)]
    arr = lk.tail_arrays(df, n=3).first()
    assert list(arr["max_demand_tail"]) == [18.0, 19.0, 20.0]
    st = lk.last_two_gas(df).first()
    assert (st.last_gas, st.prev_gas) == (19.0, 18.0)


def test_last_year_dow_modes(spark):
    data = []
    for y in (2022, 2023):
        for d in range(1, 29):
            data.append(("s", dt.date(y, 3, d), float(y - 2000)))
    df = spark.createDataFrame(data, "series_id string, date date, max_demand double")
    from loadcast.functions import calendar as cal
    df = cal.calendar_parts(cal.with_weekday(df))
    per_row = rows(fe.last_year_dow_mean(df, "per_row"), ["date"])
    assert {r[S.DEMAND_LAST_YEAR_DOW] for r in per_row if r["year"] == 2022} == {0.0}
    assert {r[S.DEMAND_LAST_YEAR_DOW] for r in per_row if r["year"] == 2023} == {22.0}
    fixed = rows(fe.last_year_dow_mean(df, "fixed"), ["date"])
    assert {r[S.DEMAND_LAST_YEAR_DOW] for r in fixed} == {22.0}
    off = fe.last_year_dow_mean(df, "disabled")
    assert {r[S.DEMAND_LAST_YEAR_DOW] for r in off.collect()} == {0.0}


def test_rank_method_matches_window_method(spark):
    rnd = random.Random(11)
    data = [("hot", day(i)) for i in range(1, 400)] + \
           [(f"s{j}", day(i)) for j in range(5) for i in rnd.sample(range(1, 60), 13)]
    df = spark.createDataFrame(data, "series_id string, date date")
    a = {(r.series_id, r.date, r.split) for r in sp.chronological_split(df).collect()}
    b = {(r.series_id, r.date, r.split) for r in
         sp.chronological_split(df, method="rank").collect()}
    assert a == b
    fa = {tuple(r) for r in sp.expanding_folds(df).collect()}
    fb = {tuple(r) for r in sp.expanding_folds(df, method="rank").collect()}
    assert fa == fb


def test_fold_blocks_by_every_method(spark):
    rnd = random.Random(12)
    data = [("hot", day(i), 1) for i in range(1, 300)] + [("short", day(i), 1) for i in range(3)] + \
           [(f"s{j}", day(i), j) for j in range(4) for i in rnd.sample(range(1, 60), 9 + j)] + [(None, day(i), 1) for i in range(8)]
    df = spark.createDataFrame(data, "series_id string, date date, _x int").repartition(5)
    want = {}
    for key in {d[0] for d in data}:
        own = sorted(d[1] for d in data if d[0] == key)
        size = len(own) // 4
        for at, d in enumerate(own):
            if size:
                want[key, d] = max(-1, (at - len(own) + 3 * size) // size)
    for method in ("window", "rank", "dates"):
        got = sp.fold_blocks(df, method=method)
        assert got.columns == [*df.columns, "block"]
        assert {(r.series_id, r.date): r.block for r in got.collect()} == want
    assert sp.fold_blocks(df.limit(0), method="dates").count() == 0


def test_fold_bounds_do_not_cut_a_date(spark):
    # 13 rows, blocks of 3 from the rows 4, 7 and 10: the second one would start within day 2, the third within day 3.
    days = [1] * 3 + [2] * 5 + [3] * 2 + [4, 5]
    df = spark.createDataFrame([("s", day(d)) for d in days] + [("s", None)], "series_id string, date date")
    blocks = {r.date: r.block for r in sp.fold_blocks(df, method="dates").collect()}
    assert blocks == {None: -1, day(1): -1, day(2): 0, day(3): 1, day(4): 2, day(5): 2}
    assert sp.fold_blocks(df, method="dates").distinct().count() == 6


def test_top_k_without_keys(spark):
    from loadcast.operators import metrics as me
    df = spark.createDataFrame([(f"f{i}", float(i % 7)) for i in range(50)], "f string, v double")
    got = [(r.f, r.rank) for r in me.top_k(df, "v", 3, tiebreak="f").orderBy("rank").collect()]
    assert got == [("f13", 1), ("f20", 2), ("f27", 3)]


def test_bucketed_asof_matches_brute_force(spark):
    rnd = random.Random(5)
    hist_rows, tgt_rows = [], []
    for s in ("hot", "b"):
        n = 300 if s == "hot" else 20
        for d in rnd.sample(range(1, 200), n // 2):
            hist_rows.append((s, day(d), None if rnd.random() < 0.2 else float(rnd.randint(1, 99))))
        for d in rnd.sample(range(1, 220), 40):
            tgt_rows.append((s, day(d), d))
    hist = spark.createDataFrame(hist_rows, "series_id string, date date, max_demand double")
    tg = spark.createDataFrame(tgt_rows, "series_id string, date date, tag int")
    for bucket in (1, 3, 16):
        got = {(r.series_id, r.date): (r.v, r.v_date, r.tag) for r in
               lk.last_before(tg, hist, S.MAX_DEMAND, out="v", bucket_days=bucket).collect()}
        assert len(got) == len(tgt_rows)
        for s, d, tag in tgt_rows:
            prior = [(hd, v) for hs, hd, v in hist_rows if hs == s and hd < d and v is not None]
            want = max(prior) if prior else None
            assert got[(s, d)] == ((want[1], want[0], tag) if want else (None, None, tag))


def test_positions_of_many_rows_with_payload_and_ties(spark):
    """Payload columns, heavy ties and no shared exchanges: positions match ``row_number``."""
    n = 400_000
    df = spark.range(n).selectExpr(
        "concat('s', cast(id % 3 as string)) series_id",
        "case when id % 2 = 0 then 0 else cast(id * 7919 % 100003 as int) end v",
        "id", "repeat(cast(id as string), 3) payload", "cast(id as double) amount")
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = rk.group_row_numbers(df, ["series_id"], ["v", "id"], out="rn", size="n")
        w = Window.partitionBy("series_id").orderBy("v", "id")
        both = got.withColumn("want", F.row_number().over(w))
        assert both.where("rn <> want").count() == 0 and both.count() == n
        loose = rk.global_positions(df.select("v", "payload"), ["v"])  # ties by a hash of the row
        assert loose.select("_gpos").distinct().count() == n
        assert loose.agg(F.max("_gpos")).first()[0] == n - 1
        low = loose.where("v = 0").agg(F.max("_gpos")).first()[0]
        assert low < loose.where("v > 0").agg(F.min("_gpos")).first()[0]
        a = sp.chronological_split(df, order=["v", "id"]).where("split = 'test'").select("id")
        b = sp.chronological_split(df, order=["v", "id"], method="rank").where("split = 'test'").select("id")
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        d = pr.describe(df, ["v", "amount"]).collect()
        v = df.agg(*[F.expr(f"percentile({c}, array(0.25, 0.5, 0.75))").alias(c) for c in ("v", "amount")]).first()
        for r in d:
            assert [r.p25, r.p50, r.p75] == [float(x) for x in v[r.column_name]]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


def test_observed_on_takes_one_row_per_date(spark):
    t = spark.createDataFrame([("s", day(1)), ("s", day(2))], "series_id string, date date")
    h = spark.createDataFrame([("s", day(1), 5.0), ("s", day(1), 3.0), ("s", day(1), None)],
                              "series_id string, date date, temp_low double")
    got = {r.date: r.obs_temp_low for r in lk.observed_on(t, h, ["temp_low"]).collect()}
    assert got == {day(1): 3.0, day(2): None}


def test_gas_before_uses_earlier_days_only(spark):
    hist = spark.createDataFrame(
        [("s", day(i), float(i) if i != 4 else None, 1.0) for i in range(1, 8)],
        "series_id string, date date, gas_demand double, solar_max double")
    t = spark.createDataFrame([("s", day(i)) for i in (1, 2, 3, 5, 8)], "series_id string, date date")
    got = {r.date: (r.last_gas, r.prev_gas) for r in lk.gas_before(t, hist).collect()}
    assert got == {day(1): (None, None), day(2): (1.0, None), day(3): (2.0, 1.0),
                   day(5): (3.0, 2.0), day(8): (7.0, 6.0)}
