"""The whole batch flow on a small CSV daily table (two series, gas columns)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from loadcast.plans import daily_run
from loadcast.plans import forecast as fc
from loadcast.plans import scoring
from loadcast.plans import training as tr


def test_daily_run_writes_all_outputs(spark, tmp_path):
    lines = ["series_id,date,max_demand,temp_high,temp_avg,temp_low,feels_like,"
             "solar_max,gas_demand,day_type,weekday_name"]
    d0 = dt.date(2023, 1, 1)
    for s, scale in (("north", 1.0), ("south", 1.5)):
        for i in range(420):
            d = d0 + dt.timedelta(days=i)
            t = 15 + 12 * math.sin(2 * math.pi * (i - 100) / 365)
            demand = scale * (1000 + 20 * abs(t - 18) + (80 if d.weekday() < 5 else 0))
            solar = scale * (100 + 3 * t)
            gas = 0.3 * demand - 0.5 * solar
            cell = "" if i % 50 == 7 else f"{demand:.2f}"
            lines.append(f"{s},{d.isoformat()},{cell},{t + 4:.1f},{t:.1f},{t - 4:.1f},"
                         f"{t + 1:.1f},{solar:.2f},{gas:.2f},,")
    src = tmp_path / "daily.csv"
    src.write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "run")
    res = daily_run.run(spark, str(src), out, tune=False, gas_cutoff=None)
    assert res["gas"] and res["note"] is None
    # A rerun to the same place overwrites everything, the models too.
    assert daily_run.run(spark, str(src), out, tune=False, gas_cutoff=None)["gas"]
    metrics = {(r.model, r.series_id): r for r in spark.read.parquet(f"{out}/metrics").collect()}
    assert {m for m, _ in metrics} == {"demand_forest", "gas_boost"}
    assert all(r.n > 0 for r in metrics.values())
    fd = spark.read.parquet(f"{out}/forecast_demand").collect()
    assert sorted(r.series_id for r in fd) == ["north", "south"]
    assert all(r.date == d0 + dt.timedelta(days=420) for r in fd)
    assert all(len(r.last_year_week) == 7 for r in fd)
    fg = spark.read.parquet(f"{out}/forecast_gas").collect()
    assert fg and all(0 <= r.gas_prediction <= r.max_demand for r in fg)
    imp = spark.read.parquet(f"{out}/importances").collect()
    assert abs(sum(r.importance for r in imp if r.model == "gas_boost") - 1) < 1e-9
    assert spark.read.parquet(f"{out}/profile").first().n_rows == 840
    # The kept models and state give the run's own forecast.
    days = spark.createDataFrame([(r.series_id, r.date) for r in fd], "series_id string, date date")
    kept = {r.series_id: r for r in scoring.score_demand(spark, f"{out}/models", f"{out}/state", days).collect()}
    assert all(math.isclose(kept[r.series_id].prediction, r.prediction) and
               math.isclose(kept[r.series_id].demand_last_week, r.demand_last_week) for r in fd)
    scen = days.withColumns({"max_demand": F.lit(1200.0), "solar_max": F.lit(150.0)})
    gas = scoring.score_gas(spark, f"{out}/models", f"{out}/state", scen, refreshed_ratios=True).collect()
    assert len(gas) == 2 and all(0 < r.gas_prediction < 1200 for r in gas)


def test_gas_model_skipped_when_cutoff_leaves_no_rows(spark, tmp_path):
    lines = ["series_id,date,max_demand,temp_high,temp_low,feels_like,solar_max,gas_demand"]
    for i in range(60):
        d = dt.date(2023, 3, 1) + dt.timedelta(days=i)
        lines.append(f"s,{d.isoformat()},{1000 + i},20,10,21,100,{300 + i}")
    src = tmp_path / "d.csv"
    src.write_text("\n".join(lines) + "\n")
    res = daily_run.run(spark, str(src), str(tmp_path / "o"), tune=False)
    assert res["gas"] is False


def _panel(spark, n=120, day_type=False):
    rows = []
    for i in range(n):
        d = dt.date(2023, 1, 2) + dt.timedelta(days=i)
        kind = "holiday" if i % 9 == 4 else None
        rows.append(("s", d, 1000.0 + 10 * (i % 7) + i, 100.0 + i % 5, 300.0 + (i * 37) % 50,
                     20.0, 10.0, 21.0, kind))
    df = spark.createDataFrame(rows, "series_id string, date date, max_demand double, solar_max double, "
                                     "gas_demand double, temp_high double, temp_low double, "
                                     "feels_like double, day_type string")
    return df if day_type else df.drop("day_type")


def test_forecast_rows_equal_training_rows(spark):
    """One path for holidays, day types and lags: no skew between training and serving."""
    panel = _panel(spark, day_type=True)
    extra = spark.createDataFrame([(dt.date(2023, 2, 14),)], "date date")
    for options in ({}, {"lag_by": "calendar"}, {"last_year_mode": "fixed"},
                    {"day_type_override": False}):
        table, features = tr.demand_training_table(panel, extra_holidays=extra, **options)
        later = table.where("date >= date'2023-01-20'")
        rows = fc.demand_feature_rows(later.select("series_id", "date"), panel, extra, **options)
        cols = [c for c in features if c != "demand_last_year_dow" or options.get("last_year_mode")]
        a = {r.date: [float(r[c]) for c in cols] for r in later.collect()}
        b = {r.date: [float(r[c]) for c in cols] for r in rows.collect()}
        assert a == b and len(a) > 90
        marked = later.where("date = date'2023-02-14'").first()
        assert marked.is_holiday == 1 and marked.is_business_day == 0


def test_gas_rows_do_not_look_ahead(spark):
    panel = _panel(spark)
    scen = panel.where("date >= date'2023-04-01'").select("series_id", "date", "max_demand", "solar_max")
    rows = {r.date: r for r in fc.gas_feature_rows(scen, panel).collect()}
    gas = {r.date: r.gas_demand for r in panel.collect()}
    one = dt.timedelta(days=1)
    for d, r in rows.items():
        assert r.gas_lag1 == gas[d - one]
        assert abs(r.gas_change_lag1 - (gas[d - one] - gas[d - 2 * one]) / gas[d - 2 * one]) < 1e-12
    # Changing everything on and after the first scenario changes no state of the first one.
    first = min(rows)
    cut = panel.where(F.col("date") < first)
    again = fc.gas_feature_rows(scen.where(F.col("date") == first), cut).first()
    assert again.asDict() == rows[first].asDict()


def test_scenario_keeps_its_own_weekday(spark):
    panel = _panel(spark)
    scen = spark.createDataFrame([("s", dt.date(2023, 4, 10), "Sunday", 1000.0, 100.0),
                                  ("s", dt.date(2023, 4, 9), "monday", 1000.0, 100.0),
                                  ("s", dt.date(2023, 4, 11), None, 1000.0, 100.0)],
                                 "series_id string, date date, weekday_name string, max_demand double, solar_max double")
    got = {r.date.day: r.is_business_day for r in fc.gas_feature_rows(scen, panel).collect()}
    assert got == {10: 0, 9: 1, 11: 1}


def test_too_short_series_are_reported_not_tuned(spark):
    t = tr.train_demand(_panel(spark, n=12).where("date < date'2023-01-06'"), tune=True)
    assert t.note and "not tuned" in t.note


def test_save_edits_job(spark, tmp_path):
    base = "series_id,date,max_demand\n" + "".join(f"s,2024-01-{d:02d},{d}\n" for d in range(1, 11))
    lines = [f"s,2024-01-{d:02d},{d + (100 if d in (2, 3, 4, 8) else 0)}\n" for d in range(1, 11) if d != 6]
    edited = "series_id,date,max_demand\n" + "".join(lines) + "s,2024-01-20,7\ns,2024-01-20,\n"
    (tmp_path / "a.csv").write_text(base)
    (tmp_path / "b.csv").write_text(edited)
    out = str(tmp_path / "out")
    res = daily_run.save_edits(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), out)
    assert (res["update"], res["insert"], res["delete"]) == (4, 1, 1)
    got = {r.date.day: r.max_demand for r in spark.read.parquet(f"{out}/table").collect()}
    assert got == {**{d: float(d + (100 if d in (2, 3, 4, 8) else 0)) for d in range(1, 11) if d != 6}, 20: 7.0}
    ranges = sorted((r.range_start.day, r.range_end.day) for r in spark.read.parquet(f"{out}/ranges").collect())
    assert ranges == [(2, 4), (8, 8)]


def test_daily_run_takes_typed_tables_and_holidays(spark, tmp_path):
    src = str(tmp_path / "typed")
    _panel(spark).withColumn("date", F.col("date").cast("timestamp")).write.parquet(src)
    daily = daily_run.load_daily(spark, src, "parquet")
    assert daily.count() == 120 and dict(daily.dtypes)["date"] == "date"
    (tmp_path / "h.csv").write_text("date,name\n2023-01-23 00:00:00,Seollal\nbad,x\n")
    assert [r.date for r in daily_run.load_holidays(spark, str(tmp_path / "h.csv")).collect()] == [dt.date(2023, 1, 23)]
