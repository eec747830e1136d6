"""Leak-free splitting by time: cutoff, day-kind segments, hold-out, folds.

Positions come from ``row_number()`` and sizes from ``count(*)`` over the
series partitioning, so splitting is lazy (no driver round trip) and every
series is split on its own. On a daily panel a series holds at most one row
per day, which bounds each window partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.operators.ranking import group_row_numbers

TRAIN, TEST = "train", "test"


def cutoff_filter(df: DataFrame, cutoff: str, date_col: str = S.DATE) -> DataFrame:
    """Rows dated on or after ``cutoff`` (pushed down to the scan when possible)."""
    return df.where(F.col(date_col) >= F.to_date(F.lit(cutoff)))


def train_size(n: Column, test_fraction: float) -> Column:
    """k = clamp(floor(n * (1 - p)), 1, n - 1); n = 1 gives k = 1 (no test row)."""
    k = F.floor(n * F.lit(1.0 - test_fraction))
    return F.greatest(F.lit(1), F.least(k, n - 1)).cast("long")


def _positions(df: DataFrame, keys: list[str], order: list[str], method: str) -> DataFrame:
    """``_rn`` (1-based, by ``order``) and ``_n`` per group.

    ``window``: one window per group (right for daily panels, where a group
    holds at most one row per day). ``rank``: distributed positions, for
    inputs where one group may hold a large share of all rows.
    """
    if method == "rank":
        return group_row_numbers(df, keys, order, out="_rn", size="_n")
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumns({"_rn": F.row_number().over(w), "_n": n})


def chronological_split(df: DataFrame, test_fraction: float = 0.2,
                        keys: list[str] | None = None, order: str | list[str] = S.DATE,
                        out: str = "split", method: str = "window") -> DataFrame:
    """First k rows (by date) of every series are ``train``, the rest ``test``."""
    keys = keys or [S.SERIES]
    order = [order] if isinstance(order, str) else list(order)
    pos = _positions(df, keys, order, method)
    return (pos.withColumn(out, F.when(F.col("_rn") <= train_size(F.col("_n"), test_fraction),
                                       F.lit(TRAIN)).otherwise(F.lit(TEST)))
            .drop("_rn", "_n"))


def fold_blocks(df: DataFrame, n_splits: int = 3, keys: list[str] | None = None,
                order: str | list[str] = S.DATE, out: str = "block", method: str = "window") -> DataFrame:
    """C8 without copies: every row once, with the number of its test block.

    A series of n rows ends with ``n_splits`` blocks of ``n // (n_splits + 1)``
    rows, numbered from 0; rows before them have -1. Fold i trains on
    ``block < i`` and tests on ``block == i``. Rows of a series that is too
    short for a block are left out.

    ``window`` and ``rank`` count rows (see :func:`_positions`). ``dates``
    joins the rows to :func:`fold_bounds`: the rows themselves are neither
    sorted nor gathered by series, and a date is never cut in two. On one row
    a date all three are equal; there ``order`` is one column.
    """
    keys = keys or [S.SERIES]
    order = [order] if isinstance(order, str) else list(order)
    if method == "dates":
        bounds = fold_bounds(df, n_splits, keys, order[0])
        own = [F.col(f"_k{i}").eqNullSafe(F.col(f"`{k}`")) for i, k in enumerate(keys)]
        bounds = bounds.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), F.col("starts").alias("_starts"))
        # A null date comes before all others, as in a sort.
        begun = F.size(F.filter("_starts", lambda x: x <= F.col(f"`{order[0]}`")))
        block = F.when(F.col(f"`{order[0]}`").isNull(), F.lit(-1)).otherwise(begun - 1)
        return (df.join(bounds, reduce(lambda a, b: a & b, own)).withColumn(out, block.cast("int"))
                .drop("_starts", *(f"_k{i}" for i in range(len(keys)))))
    base = _positions(df, keys, order, method)
    base = base.withColumn("_b", F.floor(F.col("_n") / (n_splits + 1)).cast("long")).where("_b > 0")
    first = F.col("_n") - F.lit(n_splits) * F.col("_b")
    block = F.floor((F.col("_rn") - 1 - first) / F.col("_b"))
    return base.withColumn(out, F.greatest(F.lit(-1), block).cast("int")).drop("_rn", "_n", "_b")


def fold_bounds(df: DataFrame, n_splits: int = 3, keys: list[str] | None = None,
                order: str = S.DATE) -> DataFrame:
    """One row a series, ``starts``: the first dates of its test blocks, ascending.

    Rows are counted by date first, on the map side, and only these counts are
    sorted for their running total. A block starts with the first date that
    has as many rows before it; where several blocks would start with one date
    it begins them all. Series too short for a block have no row.
    """
    keys = keys or [S.SERIES]
    by = [F.col(f"`{k}`") for k in keys]
    daily = df.groupBy(*by, F.col(f"`{order}`").alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    before = F.sum("_c").over(w.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1))
    placed = (daily.withColumns({"_rn": F.coalesce(before, F.lit(0)), "_n": F.sum("_c").over(w)})
              .withColumn("_b", F.floor(F.col("_n") / (n_splits + 1)).cast("long")).where("_b > 0"))
    start = [F.min(F.when(F.col("_rn") >= F.col("_n") - F.lit(n_splits - i) * F.col("_b"), F.col("_d"))) for i in range(n_splits)]
    return placed.groupBy(*by).agg(F.array_compact(F.array(*start)).alias("starts"))


def expanding_folds(df: DataFrame, n_splits: int = 3, keys: list[str] | None = None,
                    order: str | list[str] = S.DATE, method: str = "window") -> DataFrame:
    """The folds of :func:`fold_blocks` as one row per (row, fold) with ``role`` = train / test.

    A row is repeated for each fold that it takes part in. For a fit use the
    blocks, which repeat none.
    """
    blocks = fold_blocks(df, n_splits, keys, order, "_block", method)
    folds = F.sequence(F.greatest(F.col("_block"), F.lit(0)), F.lit(n_splits - 1))
    role = F.when(F.col("_block") < F.col("fold"), F.lit(TRAIN)).otherwise(F.lit(TEST))
    return blocks.withColumn("fold", F.explode(folds)).withColumn("role", role).drop("_block")


def split_by_day_kind(df: DataFrame, min_rows: int = 20, test_fraction: float = 0.2,
                      keys: list[str] | None = None) -> DataFrame:
    """Business-day and other-day segments, each split chronologically.

    A series gets segments only when both have at least ``min_rows`` rows
    (counted with windows, so no action runs); other series get no rows.
    """
    keys = keys or [S.SERIES]
    whole = Window.partitionBy(*keys)
    bd = F.col(S.IS_BUSINESS_DAY)
    seg = df.withColumns({
        "_nb": F.sum(bd).over(whole),
        "_no": F.sum(1 - bd).over(whole),
        "segment": F.when(bd == 1, F.lit("business")).otherwise(F.lit("other")),
    })
    seg = seg.where((F.col("_nb") >= min_rows) & (F.col("_no") >= min_rows)).drop("_nb", "_no")
    return chronological_split(seg, test_fraction, keys=keys + ["segment"])
