"""Batch run of the whole flow on a daily table (what the reference's page does
from top to bottom, as one Spark application):

read (A1) -> coerce (A2, A3) -> profile (A4) -> features -> split -> fit the
demand forest (F1 or tuned, F2) and, when gas and solar exist, the gas model
(F3) -> hold-out metrics (F10) -> forecast the next day of every series (F5,
F6) and the gas for the hold-out scenarios (F7) -> write everything.

    python -m loadcast.plans.daily_run --table data.csv --out /shared/run1 [--no-tune]

Outputs (Parquet unless noted): ``profile``, ``metrics``, ``forecast_demand``
(with the week around the date last year), ``forecast_gas``, ``importances``,
``models`` and ``state`` (read by :mod:`loadcast.plans.scoring`, which forecasts
without a fit or a scan of the history).

Saving edits is a job of its own (:func:`save_edits`): the edited table is
compared with the base by key, and the changes, their ranges and the merged
table are written.

    python -m loadcast.plans.daily_run --table data.csv --edited new.csv --out /shared/edit1
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.operators import changes as ch
from loadcast.operators import lookup as lk
from loadcast.operators import profile as pr
from loadcast.operators import split as sp
from loadcast.operators import state as st
from loadcast.plans import forecast as fc
from loadcast.plans import models as md
from loadcast.plans import scoring
from loadcast.plans import training as tr
from loadcast.sources import ingest as io


def load_daily(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A1-A3: text table -> typed daily table; a missing series id becomes a literal.

    One row per series and date (:func:`ingest.unique_daily`). The typed table
    is written once, so that profile, training and forecasts read it instead
    of parsing the source again.
    """
    raw = io.read_table(spark, path, fmt)
    missing = [c for c in S.REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    df = io.coerce_numeric(io.coerce_date(raw, S.DATE), S.NUMERIC_INPUTS)
    if S.SERIES not in df.columns:
        df = df.withColumn(S.SERIES, F.lit("default"))
    df = io.unique_daily(df.where(F.col(S.DATE).isNotNull()), [S.SERIES, S.DATE])
    return tr.materialize(df)


# The reference's defaults: the tuned forest, and gas rows from this date on.
DEFAULT_GAS_CUTOFF = "2024-12-01"
# Nodes of a tree of the demand forest; all trees are on the driver (100 of them: some 300 MB at most).
MAX_NODES = 16_383


def load_holidays(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The table of further holidays (lunar, substitute): its column ``date``."""
    return io.coerce_date(io.read_table(spark, path, fmt), S.DATE).select(S.DATE).dropna()


def save_edits(spark: SparkSession, table: str, edited: str, out: str, fmt: str = "csv",
               key: list[str] | None = None) -> dict:
    """Edit, compare, save (A5-A9): ``changes``, ``ranges`` and the merged ``table`` under ``out``.

    Ranges are runs of consecutive days with an update, per series. The base
    is left as it is; swap in ``out/table`` when the job has ended.
    """
    key = key or [S.SERIES, S.DATE]
    base, new = load_daily(spark, table, fmt), load_daily(spark, edited, fmt)
    new = ch.drop_internal(new)
    changes = ch.changed_rows(new, base, key, carry=base.columns)
    changes = tr.materialize(changes)
    changes.where(F.col("kind") != ch.SAME).write.mode("overwrite").parquet(f"{out}/changes")
    days = changes.where(F.col("kind") == ch.UPDATE).select(
        S.SERIES, F.unix_date(S.DATE).cast("long").alias("day"))
    ranges = ch.group_consecutive(days, "day", keys=[S.SERIES])
    ranges.select(S.SERIES, *[F.date_from_unix_date(F.col(c).cast("int")).alias(c)
                              for c in ("range_start", "range_end")], "n_rows") \
        .write.mode("overwrite").parquet(f"{out}/ranges")
    merged = changes.where(F.col("kind") != ch.DELETE).select(*base.columns)
    merged.write.mode("overwrite").parquet(f"{out}/table")
    kinds = changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()
    return {"out": out, **{r["kind"]: r["n"] for r in kinds}}


def run(spark: SparkSession, table: str, out: str, fmt: str = "csv", tune: bool = True,
        gas_cutoff: str | None = DEFAULT_GAS_CUTOFF, holidays: str | None = None,
        day_type_override: bool = True, gas_interactions: bool = False,
        max_nodes: int | None = MAX_NODES) -> dict:
    """The whole flow; models and state are kept under ``out`` for :mod:`loadcast.plans.scoring`."""
    daily = load_daily(spark, table, fmt)
    extra = load_holidays(spark, holidays) if holidays else None
    shared = {"extra_holidays": extra, "day_type_override": day_type_override}
    pr.profile_range(daily).write.mode("overwrite").parquet(f"{out}/profile")
    demand = tr.train_demand(daily, tune=tune, max_nodes=max_nodes, **shared)
    metrics = tr.evaluate(demand).withColumn("model", F.lit("demand_forest"))
    importances = [("demand_forest", f, v) for f, v in md.importances(demand.model,
                                                                      demand.features)]
    targets = lk.next_target_date(daily)
    fc.forecast_demand(targets, daily, demand.model, demand.features, with_last_year=True,
                       **shared).write.mode("overwrite").parquet(f"{out}/forecast_demand")
    gas = None
    has_gas = all(c in daily.columns for c in S.GAS_INPUTS) and \
        daily.where(F.col(S.GAS_DEMAND).isNotNull()).take(1)
    if has_gas and gas_cutoff:
        has_gas = daily.where((F.col(S.DATE) >= F.to_date(F.lit(gas_cutoff)))
                              & F.col(S.GAS_DEMAND).isNotNull()).take(1)
    if has_gas:
        gas = tr.train_gas(daily, cutoff=gas_cutoff, interactions=gas_interactions, **shared)
        gmetrics = tr.evaluate(gas).withColumn("model", F.lit("gas_boost"))
        metrics = metrics.unionByName(gmetrics)
        overall = tr.evaluate(gas, keys=[]).first()
        scen = gas.table.where(F.col("split") == sp.TEST).select(
            S.SERIES, S.DATE, S.MAX_DEMAND, S.SOLAR_MAX)
        fc.forecast_gas(scen, daily, gas.model, gas.features,
                        r2=overall["r2"] if overall else None, ratios=gas.ratios, **shared) \
            .write.mode("overwrite").parquet(f"{out}/forecast_gas")
        importances += [("gas_boost", f, v) for f, v in md.importances(gas.model,
                                                                       gas.features)]
        if isinstance(gas.model, md.MonotoneBoostModel):
            spark.createDataFrame([(gas.model.to_json(),)], "model string") \
                .write.mode("overwrite").text(f"{out}/models/gas.json")
    scoring.save_models(f"{out}/models", demand, gas)
    absent = [c for c in st.RECENT if c not in daily.columns]
    scoring.save_state(daily.withColumns({c: F.lit(None).cast("double") for c in absent}), f"{out}/state",
                       **shared)
    metrics.write.mode("overwrite").parquet(f"{out}/metrics")
    spark.createDataFrame(importances, "model string, feature string, importance double") \
        .write.mode("overwrite").parquet(f"{out}/importances")
    return {"out": out, "gas": bool(has_gas), "note": demand.note}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    ap.add_argument("--table", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="csv")
    ap.add_argument("--no-tune", dest="tune", action="store_false",
                    help="fit the plain 100-tree forest instead of the tuned one")
    ap.add_argument("--gas-cutoff", default=DEFAULT_GAS_CUTOFF,
                    help="first date of gas training rows ('' for all rows)")
    ap.add_argument("--gas-interactions", action="store_true",
                    help="fit the gas model as monotone trees with interactions")
    ap.add_argument("--max-nodes", type=int, default=MAX_NODES,
                    help="most nodes of a tree of the demand forest (0: as many as the rows ask for)")
    ap.add_argument("--holidays", help="table with the dates of further holidays (CSV)")
    ap.add_argument("--ignore-day-type", dest="day_type", action="store_false",
                    help="business days by the calendar alone, whatever day type is given")
    ap.add_argument("--edited", help="save these edits of the table instead of forecasting")
    args = ap.parse_args(argv)
    from loadcast.session import build_session, checkpoint_root
    spark = build_session()
    checkpoint_root(spark)
    if args.edited:
        print(save_edits(spark, args.table, args.edited, args.out, args.format))
        return
    print(run(spark, args.table, args.out, args.format, args.tune, args.gas_cutoff or None,
              args.holidays, args.day_type, args.gas_interactions, args.max_nodes or None))


if __name__ == "__main__":
    main()
