"""Kept state against state computed afresh; scoring from it; quarantined lines."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.operators import changes as ch
from loadcast.operators import features as fe
from loadcast.operators import lookup as lk
from loadcast.operators import state as st
from loadcast.plans import forecast as fc
from loadcast.plans import models as md
from loadcast.plans import scoring
from loadcast.plans import training as tr
from loadcast.sources import ingest as io

SCHEMA = "series_id string, date date, max_demand double, gas_demand double, solar_max double"
KEY = [S.SERIES, S.DATE]


def panel(seed, days=150):
    r = random.Random(seed)
    some = lambda p: None if r.random() < 0.1 else float("nan") if r.random() < 0.03 else p
    return {(s, dt.date(2023, 11, 1) + dt.timedelta(i)):
            (some(round(r.uniform(10, 99), 3)), some(round(r.uniform(1, 9), 3)), some(round(r.uniform(1, 9), 3)))
            for s in "AB" for i in range(days)}


def frame(spark, cells):
    return spark.createDataFrame([(*k, *v) for k, v in cells.items()], SCHEMA)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))



def counted(spark, df):
    """The rows of ``df``, and how many of them have been computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


def test_an_update_computes_its_change_set_once(spark, tmp_path):
    old = panel(4)
    o = frame(spark, old)
    n = frame(spark, {k: (v[0], 5.0, 1.0) for k, v in old.items() if k[1].day != 9})
    changes = ch.changed_rows(n, o, KEY).where(F.col("kind") != ch.SAME).coalesce(1)
    wanted = changes.count()
    changes, seen = counted(spark, changes)
    before, after = str(tmp_path / "before"), str(tmp_path / "after")
    scoring.save_state(o, before)
    scoring.update_state(spark, before, after, changes, o, n)
    assert seen.value == wanted > 0


def test_queries_of_kept_state_sum_up_the_raw_rows_once(spark, monkeypatch):
    from loadcast.catalog import state_queries as sq
    from loadcast.sources import panels

    cells = frame(spark, panel(5)).replace(float("nan"), None).withColumns(
        {c: F.lit(20.0) for c in (S.TEMP_HIGH, S.TEMP_LOW, S.FEELS_LIKE, S.TEMP_AVG)})
    wanted, (cells, seen) = cells.count(), counted(spark, cells)
    monkeypatch.setattr(panels, "demand_panel", lambda spark, sf: cells)
    assert sq.d1_state_after_changes(spark, "no such folder").count() > 0
    assert sq.c6_state_after_changes(spark, "no such folder").count() == 2
    assert seen.value == wanted


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_updated_state_equals_fresh_state(spark, tmp_path, seed):
    r = random.Random(seed)
    old = panel(seed)
    new = dict(old)
    months = r.sample(range(11, 16), 3)
    for k in list(new):
        if (k[1].year - 2023) * 12 + k[1].month in months:
            if (p := r.random()) < 0.2:
                del new[k]
            elif p < 0.4:
                new[k] = (round(r.uniform(10, 99), 3), None, 2.0)
    new["C", dt.date(2024, 5, 5)] = (5.0, 1.0, 1.0)
    o, n = frame(spark, old), frame(spark, new)
    before, after, fresh = (str(tmp_path / x) for x in ("before", "after", "fresh"))
    scoring.save_state(o, before)
    scoring.save_state(n, fresh)
    changes = ch.changed_rows(n, o, KEY).where(F.col("kind") != ch.SAME)
    scoring.update_state(spark, before, after, changes, o, n)
    for name in ("month_weekday", "day_kind", "recent"):
        got = spark.read.parquet(f"{after}/{name}")
        assert got.count() > 0 and same(got, spark.read.parquet(f"{fresh}/{name}")), name
    plain = n.replace(float("nan"), None)
    rows = st.calendar_rows(plain)
    mine = {tuple(x)[:4]: tuple(x)[4:] for x in st.month_weekday_means(
        spark.read.parquet(f"{after}/month_weekday")).collect()}
    for x in fe.month_weekday_table(rows).select(*st.MONTH_WEEKDAY.keys, "mean_max_demand", "n_days").collect():
        mean, days = mine.pop(tuple(x)[:4])
        assert days == x.n_days and mean == pytest.approx(x.mean_max_demand)
    assert not mine
    ratios = {x[0]: tuple(x)[1:] for x in st.ratio_means(spark.read.parquet(f"{after}/day_kind")).collect()}
    for x in fe.ratio_means_table(rows).collect():
        assert ratios[x[0]] == pytest.approx(tuple(x)[1:])
    assert same(lk.last_two_gas(n), lk.last_two_gas(spark.read.parquet(f"{after}/recent")))
    assert same(lk.tail_values(n, n=7), lk.tail_values(spark.read.parquet(f"{after}/recent"), n=7))


def test_no_change_and_empty_table(spark, tmp_path):
    o = frame(spark, panel(4, 20))
    none = ch.changed_rows(o, o, KEY).where(F.col("kind") != ch.SAME)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    scoring.save_state(o, a)
    scoring.update_state(spark, a, b, none, o, o)
    assert all(same(spark.read.parquet(f"{a}/{n}"), spark.read.parquet(f"{b}/{n}"))
               for n in ("month_weekday", "day_kind", "recent"))
    empty = spark.createDataFrame([], SCHEMA)
    scoring.save_state(empty, a)
    scoring.update_state(spark, a, b, ch.changed_rows(empty, o, KEY), o, empty)
    assert all(spark.read.parquet(f"{a}/{n}").isEmpty() for n in ("month_weekday", "day_kind", "recent"))


def test_everything_deleted_leaves_no_cell(spark, tmp_path):
    o, empty = frame(spark, panel(5, 40)), spark.createDataFrame([], SCHEMA)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    scoring.save_state(o, a)
    scoring.update_state(spark, a, b, ch.changed_rows(empty, o, KEY), o, empty)
    assert all(spark.read.parquet(f"{b}/{n}").isEmpty() for n in ("month_weekday", "day_kind", "recent"))


def test_scoring_from_state_equals_the_whole_history(spark, tmp_path):
    r = random.Random(9)
    hist = spark.createDataFrame(
        [(s, dt.date(2023, 1, 1) + dt.timedelta(i), round(50 + 10 * r.random() + i % 7, 2), round(5 + r.random(), 2),
          round(2 + r.random(), 2), 3.0, 20.0, 18.0)
         for s in "AB" for i in range(420) if i % 9], SCHEMA + ", temp_low double, temp_high double, feels_like double")
    demand = tr.train_demand(hist)
    gas = tr.train_gas(hist, interactions=True, max_depth=2, patience=1)
    models, kept = str(tmp_path / "models"), str(tmp_path / "state")
    scoring.save_models(models, demand, gas)
    scoring.save_state(hist, kept)
    days = spark.createDataFrame([(s, dt.date(2024, 2, 25) + dt.timedelta(i)) for s in "AB" for i in range(9)]
                                 + [("new", dt.date(2024, 3, 1))], "series_id string, date date")
    full = fc.forecast_demand(days, hist, demand.model, demand.features)
    lean = scoring.score_demand(spark, models, kept, days)
    want = {tuple(x)[:2]: tuple(x)[2:] for x in full.collect()}
    got = {tuple(x)[:2]: tuple(x)[2:] for x in lean.collect()}
    assert len(want) == 19 and {k: pytest.approx(v) for k, v in want.items()} == got
    scen = days.withColumns({S.MAX_DEMAND: F.lit(60.0), S.SOLAR_MAX: F.lit(2.5)})
    want = {tuple(x)[:2]: x.gas_prediction for x in
            fc.forecast_gas(scen, hist, gas.model, gas.features, ratios=gas.ratios).collect()}
    got = {tuple(x)[:2]: x.gas_prediction for x in scoring.score_gas(spark, models, kept, scen).collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    with pytest.raises(Exception, match="target within the history"):
        scoring.score_demand(spark, models, kept, hist.select(S.SERIES, S.DATE)).collect()
    trees = md.BoostedTrees([], {}, None)
    with pytest.raises(ValueError, match="cannot be kept"):
        scoring.save_models(models, demand, tr.Trained(trees, [], hist, S.GAS_DEMAND))


def test_bad_lines_are_kept_apart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text('date,x\n2024-01-01,5\n2024-01-03,7,9\n2024-01-04\n\n2024-01-05,"1,000"\n,\n')
    (src / "b.csv").write_text("date,x\n2024-01-06,6\nü,,\n")
    good, bad = io.read_with_bad_lines(spark, str(src))
    assert sorted((r.date, r.x) for r in good.collect() if r.date) == [
        ("2024-01-01", "5"), ("2024-01-05", "1,000"), ("2024-01-06", "6")]
    assert good.count() == 4 and good.select("x").count() == 4
    assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in bad.collect()) == [
        ("a.csv", "2024-01-03,7,9"), ("a.csv", "2024-01-04"), ("b.csv", "ü,,")]
    for _ in range(2):
        rows = io.read_with_quarantine(spark, str(src), str(tmp_path / "q"))
        assert rows.count() == 4 and spark.read.parquet(str(tmp_path / "q")).count() == 3
