"""Hold-out metrics (MAE, R2), ranked importances and previews.

Metrics are single-pass grouped aggregates, so they partially aggregate on
every task and shuffle one row per task and group, however large the
hold-out is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcast import schema as S


def regression_metrics(df: DataFrame, label: str, prediction: str,
                       keys: list[str] | None = None) -> DataFrame:
    """D6 + D7: ``mae``, ``r2`` and ``n`` per group (``keys=[]`` for one overall row).

    R2 = 1 - SS_res / SS_tot with SS_tot = n * population variance, which Spark
    accumulates around the mean: labels far from zero lose no digits. A
    constant label gives 1 when SS_res = 0 and 0 otherwise (the finite convention).
    """
    keys = [S.SERIES] if keys is None else keys
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    ok = df.where(y.isNotNull() & p.isNotNull())
    agg = (ok.groupBy(*keys) if keys else ok.groupBy()).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sum((y - p) * (y - p)).alias("_ssr"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"))
    r2 = (F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_ssr") / F.col("_sst"))
          .when(F.col("_ssr") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return agg.select(*keys, "n", "mae", r2.alias("r2"))


def top_k(df: DataFrame, score: str, k: int = 2, keys: list[str] | None = None,
          tiebreak: str | None = None) -> DataFrame:
    """The ``k`` highest scores per group, with ``rank`` 1..k.

    ``row_number() <= k`` lets Spark cut each group to k rows per task before
    the shuffle.
    """
    keys = keys or []
    order = [F.col(score).desc()] + ([F.col(tiebreak)] if tiebreak else [])
    if not keys:
        # Whole-table top-k: a distributed take-ordered (k rows per task), then
        # the rank over those k rows only.
        top = df.orderBy(*order).limit(k)
        return top.withColumn("rank", F.row_number().over(
            Window.partitionBy(F.lit(0)).orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def preview(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """First ``n`` rows by key order (a distributed top-n, not a collect)."""
    order = order or [S.SERIES, S.DATE]
    return df.orderBy(*order).limit(n)
