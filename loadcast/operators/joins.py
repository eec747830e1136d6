"""Join helpers: size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has no more than ``max_rows`` rows.

    Reads at most ``max_rows + 1`` rows, so the check costs a bounded scan even
    when the table turns out to be large.
    """
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when the row count is proven to be under ``max_rows``.

    Above the bound the frame is returned unchanged and Spark (with AQE) picks
    a shuffle join, or a broadcast if the runtime size turns out small.
    """
    return F.broadcast(df) if has_at_most(df, max_rows) else df
