"""Training flow: feature table -> model matrices -> split -> fit -> evaluate.

The feature table is one lazy plan over the daily panel; it is written once
to the shared checkpoint folder (``checkpoint()``), so the folds, the fits
and the scoring all read the same materialized rows and a lost executor never
replays the whole feature lineage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.functions import scalars as sc
from loadcast.operators import features as fe
from loadcast.operators import metrics as me
from loadcast.operators import split as sp
from loadcast.plans import models as md
from loadcast.session import checkpoint_root


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def demand_training_table(panel: DataFrame, lag_by: str = "rows",
                          last_year_mode: str = "per_row", test_fraction: float = 0.2,
                          extra_holidays: DataFrame | None = None,
                          day_type_override: bool = True) -> tuple[DataFrame, list[str]]:
    """Steps 2-3 for peak demand: features, lag fill, complete cases, split."""
    ft = fe.build_features(panel, lag_by=lag_by, last_year_mode=last_year_mode,
                           extra_holidays=extra_holidays, day_type_override=day_type_override)
    features = S.demand_features(ft.columns)
    ft = sc.fill_lags(ft)
    ft = sc.complete_cases(ft, features, S.MAX_DEMAND)
    ft = sp.chronological_split(ft, test_fraction)
    return ft, features


def gas_training_table(panel: DataFrame, cutoff: str | None = None,
                       test_fraction: float = 0.2,
                       fit_ratios_on: str = "train",
                       extra_holidays: DataFrame | None = None,
                       day_type_override: bool = True) -> tuple[DataFrame, list[str]]:
    """Gas rows: features, cutoff (B20), non-null target, split, budget.

    The business/other ratio means behind ``gas_budget`` are fitted on the
    training split only (``fit_ratios_on="all"`` for the reference's rule).
    """
    ft = fe.build_features(panel, extra_holidays=extra_holidays,
                           day_type_override=day_type_override)
    if S.GAS_DEMAND not in ft.columns:
        raise ValueError("gas model needs gas_demand and solar_max")
    if cutoff:
        ft = sp.cutoff_filter(ft, cutoff)
    ft = ft.where(F.col(S.GAS_DEMAND).isNotNull())
    ft = sp.chronological_split(ft, test_fraction)
    mask = (F.col("split") == sp.TRAIN) if fit_ratios_on == "train" else None
    ratio = fe.ratio_mean_columns(mask)
    ft = ft.withColumns(ratio)
    pick = F.when(F.col(S.IS_BUSINESS_DAY) == 1, F.col("ratio_business")) \
        .otherwise(F.col("ratio_other"))
    ft = ft.withColumn(S.GAS_BUDGET, sc.gas_budget_expr(F.col(S.MAX_DEMAND), pick,
                                                        F.col(S.SOLAR_MAX)))
    ft = ft.drop("ratio_business", "ratio_other")
    features = S.gas_features(ft.columns)
    if len(features) < 2:
        raise ValueError("gas model needs at least two features")
    return ft, features


@dataclass
class Trained:
    """A fitted model with its table; ``note`` says what was done otherwise than asked.

    ``ratios`` (gas) is the state behind the budget: the ratio means of the
    training rows, one row per series.
    """

    model: object
    features: list[str]
    table: DataFrame
    label: str
    note: str | None = None
    ratios: DataFrame | None = None


def train_demand(panel: DataFrame, tune: bool = False, max_nodes: int | None = None, **kw) -> Trained:
    """F1 / F2: fit the peak-demand forest on the training split.

    ``max_nodes`` bounds the nodes of each tree, and with them the driver's memory.

    With ``tune=True`` the tuned forest is used. Series that are too short for
    the time folds leave nothing to tune on; then the plain 100-tree forest is
    fitted and ``note`` says so. Any other failure is raised.
    """
    table, features = demand_training_table(panel, **kw)
    table = materialize(table)
    train = table.where(F.col("split") == sp.TRAIN)
    if tune:
        try:
            return Trained(md.tune_forest(train, features, max_nodes=max_nodes).model, features, table, S.MAX_DEMAND)
        except md.NoFoldRows as err:
            plain = md.fit_demand_forest(train, features, max_nodes=max_nodes)
            return Trained(plain, features, table, S.MAX_DEMAND, note=f"not tuned: {err}")
    return Trained(md.fit_demand_forest(train, features, max_nodes=max_nodes), features, table, S.MAX_DEMAND)


def train_gas(panel: DataFrame, cutoff: str | None = None, monotone: bool = True,
              extra_holidays: DataFrame | None = None, day_type_override: bool = True,
              **kw) -> Trained:
    """fit the gas model on the training split."""
    table, features = gas_training_table(panel, cutoff, extra_holidays=extra_holidays,
                                         day_type_override=day_type_override)
    table = materialize(table)
    train = table.where(F.col("split") == sp.TRAIN)
    model = md.fit_gas_model(train, features, monotone=monotone, **kw)
    return Trained(model, features, table, S.GAS_DEMAND, ratios=fe.ratio_means_table(train))


def holdout_predictions(t: Trained) -> DataFrame:
    test = t.table.where(F.col("split") == sp.TEST)
    pred = md.predict(t.model, test, t.features)
    return pred.select(S.SERIES, S.DATE, F.col(t.label).alias("actual"), "prediction")


def evaluate(t: Trained, keys: list[str] | None = None) -> DataFrame:
    """hold-out MAE and R2 (D6, D7) per series (``keys=[]`` for overall)."""
    keys = [S.SERIES] if keys is None else keys
    return me.regression_metrics(holdout_predictions(t), "actual", "prediction", keys)
