"""Scoring from what a training run has kept (F5, F7): models, ratio means and
state tables. No fit and no scan of the history; the lags come from the kept
last rows, the prior year's means from the kept sums.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.operators import state as st
from loadcast.plans import forecast as fc
from loadcast.plans import models as md
from loadcast.plans import training as tr
from loadcast.plans.trees import MonotoneTrees

GAS_KINDS = {"MonotoneBoostModel": md.MonotoneBoostModel, "MonotoneTrees": MonotoneTrees}
ADDITIVE = {"month_weekday": st.MONTH_WEEKDAY, "day_kind": st.DAY_KIND}


def save_state(history: DataFrame, path: str, **calendar) -> None:
    """The state tables of a daily table, under ``path``.

    ``calendar``: ``extra_holidays`` and ``day_type_override`` of training; pass
    the same to the functions below. Each table reads ``history`` once, so pass
    one that is stored.
    """
    rows = st.calendar_rows(history, **calendar)
    for name, table in ADDITIVE.items():
        table.fresh(rows).write.mode("overwrite").parquet(f"{path}/{name}")
    st.last_rows(history).write.mode("overwrite").parquet(f"{path}/recent")


def update_state(spark: SparkSession, before: str, after: str, changes: DataFrame, old: DataFrame,
                 new: DataFrame, key: list[str] | None = None, **calendar) -> None:
    """The state under ``before`` brought up to date by a change set, written under ``after``.

    Another folder, so that a job that ends midway is simply run again. The
    change set and the rows it takes away are written first: every table reads
    them, and they would compare both tables again each time.
    """
    removed, added = map(tr.materialize, st.old_and_new(tr.materialize(changes), old, key or [S.SERIES, S.DATE]))
    gone, come = st.calendar_rows(removed, **calendar), st.calendar_rows(added, **calendar)
    for name, table in ADDITIVE.items():
        table.update(spark.read.parquet(f"{before}/{name}"), gone, come) \
            .write.mode("overwrite").parquet(f"{after}/{name}")
    st.update_last_rows(spark.read.parquet(f"{before}/recent"), new, removed, added) \
        .write.mode("overwrite").parquet(f"{after}/recent")


def save_models(path: str, demand: tr.Trained, gas: tr.Trained | None = None) -> None:
    """The models, the gas features and the trained ratio means, under ``path``.

    The gas model is one that :data:`GAS_KINDS` names; another kind is a ``ValueError``.
    """
    kind = type(gas.model).__name__ if gas else None
    if gas and kind not in GAS_KINDS:
        raise ValueError(f"a gas model of kind {kind} cannot be kept")
    demand.model.save(f"{path}/demand")
    if not gas:
        return
    spark = gas.table.sparkSession
    meta = json.dumps({"kind": kind, "features": gas.features, "model": gas.model.to_json()})
    spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").text(f"{path}/gas")
    gas.ratios.write.mode("overwrite").parquet(f"{path}/ratios")


def _after_history(targets: DataFrame, recent: DataFrame) -> DataFrame:
    """``targets``, of which one on or before its series' last kept day is an error."""
    last = recent.groupBy(S.SERIES).agg(F.max(S.DATE).alias("_last"))
    late = F.raise_error(F.concat(F.lit("target within the history: "), F.to_json(F.struct(S.SERIES, S.DATE))))
    checked = F.when(F.col(S.DATE) <= F.col("_last"), late.cast("date")).otherwise(F.col(S.DATE))
    return targets.join(last, S.SERIES, "left").withColumn(S.DATE, checked).drop("_last")


def score_demand(spark: SparkSession, models: str, state: str, targets: DataFrame, **calendar) -> DataFrame:
    """F5 and F6 for targets after the history: the forecast that the whole history gives."""
    model = md.ForestEnsemble.load(spark, f"{models}/demand")
    recent = spark.read.parquet(f"{state}/recent")
    means = st.month_weekday_means(spark.read.parquet(f"{state}/month_weekday"))
    return fc.forecast_demand(_after_history(targets, recent), recent, model, model.features,
                              month_weekday=means, **calendar)


def score_gas(spark: SparkSession, models: str, state: str, scenarios: DataFrame,
              r2: float | None = None, refreshed_ratios: bool = False, **calendar) -> DataFrame:
    """F7 for scenarios after the history. The ratio means are those of training, or with
    ``refreshed_ratios`` those of all rows in the state."""
    meta = json.loads(spark.read.text(f"{models}/gas").first()[0])
    model = GAS_KINDS[meta["kind"]].from_json(meta["model"])
    recent = spark.read.parquet(f"{state}/recent")
    ratios = st.ratio_means(spark.read.parquet(f"{state}/day_kind")) if refreshed_ratios \
        else spark.read.parquet(f"{models}/ratios")
    return fc.forecast_gas(_after_history(scenarios, recent), recent, model, meta["features"], r2,
                           ratios=ratios, **calendar)
